"""All registered queries and the SQL that checks them, gathered from the query modules."""

from __future__ import annotations

from . import queries_kpi, queries_merge, queries_quality, queries_rank, queries_star, queries_text

MODULES = (queries_kpi, queries_merge, queries_text, queries_rank, queries_quality, queries_star)
QUERIES = {name: q for m in MODULES for name, q in m.BOOK.queries.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.BOOK.sql.items()}
