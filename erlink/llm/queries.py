"""Queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WHERE = {
    "op1_nbsvm": "nbsvm",
    "op2_fm_index": "fmindex",
    "op3_minimax": "sharding",
    "op4_katz": "katz",
    "op5_bpe": "bpe",
    "op6_simhash": "simhash",
    "op7_pq": "pq",
    "op8_tag_path": "tagpath",
    "op9_suffix": "suffix",
    "op10_chat": "chat",
}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(importlib.import_module(f"erlink.llm.{_WHERE[name]}"), name)(spark, sf_dir)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in _WHERE} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    from erlink.llm import oracles

    return oracles.SQL
