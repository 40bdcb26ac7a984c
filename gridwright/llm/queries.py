"""Registered queries of this subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridwright.llm.common import ship_code

#: Query name -> module with ``query(spark, folder)`` and perhaps ``SQL``.
MODULES = {
    "op1_secrets": "secrets",
    "op2_jpeg_media": "jpeg_store",
    "op3_line_labels": "line_labels",
    "op4_suffix_dedup": "suffix_levels",
    "op6_near_copies": "near_copies",
    "op5_url_filter": "url_filter",
    "op8_tool_calls": "tool_calls",
    "op7_packing": "packing",
    "op9_piece_bpe": "piece_bpe",
    "op10_substring_dedup": "substring_words",
    "op11_turn_repair": "turn_repair",
    "op12_vector_cells": "vector_cells",
    "op13_merkle_manifest": "merkle_manifest",
}


def _runner(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_code(spark)
        return build(spark, folder)

    return run


def _load():
    found, sql = {}, {}
    for name, module in MODULES.items():
        loaded = importlib.import_module(f"gridwright.llm.{module}")
        found[name] = _runner(loaded.query)
        if getattr(loaded, "SQL", None):
            sql[name] = loaded.SQL
    return found, sql


QUERIES, SQL = _load()
