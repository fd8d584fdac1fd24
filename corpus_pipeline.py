"""Corpus cleaning in five stages, each one of the operators of ``erlink.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of ``documents``; the last returns what encoding gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from erlink.llm.bpe import encode_documents, tokenizer_path
from erlink.llm.common import stored, table
from erlink.llm.fmindex import decontaminate_stage
from erlink.llm.nbsvm import quality_stage
from erlink.llm.simhash import dedup_stage
from erlink.llm.suffix import substring_stage


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document."""
    return encode_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("BPE encoding", encode_stage),
]

#: No stage but the last two could be stated in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
