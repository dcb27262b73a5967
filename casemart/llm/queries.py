"""The queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op10_byte_bpe
from .classifier import op7_quality_classifier
from .conversation_repair import OP12_SQL, op12_conversation_repair
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .mixing import OP3_SQL, op3_mixing
from .near_dedup import op9_near_dedup
from .periodic_runs import op11_periodic_runs
from .prefix_bpe import op13_prefix_bpe
from .quality import OP2_SQL, op2_quality_rules
from .sharding import op1_sharding
from .substring_dedup import op4_substring_dedup
from .token_files import op5_token_files
from .warc_audit import OP6_SQL, op6_warc_audit

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_files": op5_token_files,
    "op6_warc_audit": op6_warc_audit,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_bpe": op13_prefix_bpe,
}

ORACLE: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op6_warc_audit": OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op12_conversation_repair": OP12_SQL,
}
