"""The training-data queries and their SQL, by name; __spark_entry__.py adds them where this imports."""

from __future__ import annotations

from plexigraph.llm.decontaminate import OP2_SQL, op2_decontamination
from plexigraph.llm.language_id import op5_language_id
from plexigraph.llm.line_dedup import OP6_SQL, op6_line_dedup
from plexigraph.llm.near_dedup import op10_minhash_near_dedup
from plexigraph.llm.packing import op1_best_fit_packing
from plexigraph.llm.quality_net import op9_quality_classifier
from plexigraph.llm.quality_rules import OP3_SQL, op3_quality_rules
from plexigraph.llm.secrets import OP8_SQL, op8_secret_scans
from plexigraph.llm.sharding import op7_sharding
from plexigraph.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontamination": op2_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_secret_scans": op8_secret_scans,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

SQL = {
    "op2_decontamination": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_line_dedup": OP6_SQL,
    "op8_secret_scans": OP8_SQL,
}
