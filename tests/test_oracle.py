import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

from casemart.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, datetime.datetime) else v


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    assert got[1], "no rows"
    if name in registry.ORACLE:
        want = duck.sql(registry.ORACLE[name])
        assert got == table(want.columns, want.fetchall())
