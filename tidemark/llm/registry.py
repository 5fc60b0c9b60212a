"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    conversation_repair, embedding_dedup, fingerprints, language_id, line_dedup, minhash_dedup, mixing, packing, sharding, source_audit, substring_dedup,
    toxicity, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_sharding": sharding.op8_sharding,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_source_audit": source_audit.op11_source_audit,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op3_minhash_dedup": minhash_dedup.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op9_embedding_dedup": embedding_dedup.ORACLE,
    "op11_source_audit": source_audit.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
}
