"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name, module of the operator.
_MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_url_filter": "url_filter",
    "op3_substring_dedup": "substring_dedup",
    "op4_license_scan": "license_scan",
    "op5_minhash_near_dedup": "near_duplicates",
    "op6_token_shards": "token_shards",
    "op7_bpe": "bpe",
    "op8_packing": "packing",
    "op9_ann": "ann",
    "op10_language_id": "language_id",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"tessera.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _MODULES.items():
        sql = getattr(import_module(f"tessera.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
