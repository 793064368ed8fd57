"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op7_decontamination
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_extract import op3_html_extract
from .jaccard_join import OP11_SQL, op11_jaccard_join
from .license_scan import op1_license_scan
from .lm_scoring import op9_lm_scoring
from .mixing import OP2_SQL, op2_mixing
from .quality_rules import OP6_SQL, op6_quality_rules
from .sharding import op8_sharding
from .simhash import op4_simhash
from .substring_dedup import OP10_SQL, op10_substring_dedup
from .vector_codes import OP12_SQL, op12_vector_codes
from .warc import OP5_SQL, op5_warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_mixing": op2_mixing,
    "op3_html_extract": op3_html_extract,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_sharding": op8_sharding,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_hard_negatives": op13_hard_negatives,
}

#: The others have no SQL form; tests/llm holds them against brute force, round trips or held-out text.
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op5_warc": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_jaccard_join": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
