"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import dart_minhash, decontaminate, impact_search, language_id, license_scan, line_crf, line_dedup, pfair_mix, sstable, token_counts

OPERATORS = {
    "op1_decontaminate": decontaminate,
    "op2_token_counts": token_counts,
    "op3_sstable": sstable,
    "op4_line_dedup": line_dedup,
    "op5_impact_search": impact_search,
    "op6_line_crf": line_crf,
    "op7_language_id": language_id,
    "op8_dart_minhash": dart_minhash,
    "op9_pfair_mix": pfair_mix,
    "op10_license_scan": license_scan,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in OPERATORS.items() if getattr(module, "ORACLE_SQL", None)}
