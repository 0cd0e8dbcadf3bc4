"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideflow.llm import decontamination, exact_dedup, lloyd, mixing, quality, repeats, secrets, sharding, simhash, style_tree, toxicity, turn_trie, warc

_MODULES = (simhash, mixing, exact_dedup, toxicity, sharding, repeats, decontamination, quality, warc, secrets, style_tree, lloyd, turn_trie)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
