"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name: the module that has query(spark, sf_dir), and ORACLE_SQL where SQL can express it.
MODULES = {
    "op1_pii_spans": "pii",
    "op2_quality_machine": "quality",
    "op3_projected_neighbours": "neighbours",
    "op4_chat_windows": "chat",
    "op5_perplexity_bands": "perplexity",
    "op7_cost_balanced_packing": "packing",
    "op6_source_mixing": "mixing",
    "op8_viterbi_token_counts": "unigram_counts",
    "op9_substring_dedup": "substrings",
    "op10_simhash_near_dedup": "simhash",
    "op11_conversation_trie": "trie",
    "op12_kd_tree_search": "exact_search",
    "op13_dual_tree_lloyd": "lloyd",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return importlib.import_module(f"tessera.llm.{module}").query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"tessera.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
