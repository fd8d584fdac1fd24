"""Truth lists, labels, negatives and splits.

Sampling and splitting go by md5 buckets of the ids: the same rows on every
run, at every partitioning, and in any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_bucket(c: Column, n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(n))


def explode_truth(truth: DataFrame) -> DataFrame:
    """(s1_id, cand_id) of (source1_entity_id, matched_entity_ids); empty items drop out."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split("matched_entity_ids", ",")).alias("cand_id")).where("cand_id <> ''")


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairs with label 1 where they are in the exploded truth, else 0."""
    return pairs.join(truth.select("s1_id", "cand_id").distinct().withColumn("label", F.lit(1)), ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def positives(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_semi").withColumn("label", F.lit(1))


def negatives(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").withColumn("label", F.lit(0))


def sample_share(n_positive: int, n_pairs: int, ratio: float) -> float:
    """Per cent of pairs to keep for ``ratio`` negatives per positive, relative to all pairs."""
    return min(100.0, max(1e-4, 100.0 * ratio * n_positive / max(1, n_pairs)))


def sample_negatives(neg: DataFrame, percent: float) -> DataFrame:
    return neg.where(md5_bucket(F.concat_ws("|", "s1_id", "cand_id"), 1_000_000) < int(percent * 1e4))


def training_pairs(pairs: DataFrame, truth: DataFrame, ratio: float = 4.0) -> DataFrame:
    """All positives and a hash sample of the negatives."""
    pos, neg = positives(pairs, truth), negatives(pairs, truth)
    return pos.unionByName(sample_negatives(neg, sample_share(pos.count(), pairs.count(), ratio)))


def random_negatives(neg: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n negatives (all where there are fewer), those of smallest seeded hash, whatever the partitioning."""
    return neg.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "s1_id", "cand_id")), "s1_id", "cand_id").limit(n)


def grouped_split(pairs: DataFrame, share: float = 0.2, key: str = "s1_id") -> DataFrame:
    """is_val per row; all rows of a group fall on one side."""
    return pairs.withColumn("is_val", md5_bucket(F.col(key), 1000) < int(round(share * 1000)))


def heldout_ids(pairs: DataFrame, share: float = 0.2) -> DataFrame:
    return grouped_split(pairs, share).where("is_val").select("s1_id").distinct()


def restrict(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    return pairs.join(ids.select("s1_id"), "s1_id", "left_semi")


def inference_pairs(candidates: DataFrame) -> DataFrame:
    return candidates


def ids_of_country(ids: DataFrame, countries: DataFrame, country: str) -> DataFrame:
    """Ids (s1_id) whose (entity_id, country) says so."""
    wanted = countries.where(F.lower(F.trim("country")) == country).select(F.col("entity_id").alias("s1_id"))
    return ids.join(wanted, "s1_id", "left_semi")


def hard_negatives(s1: DataFrame, cands: DataFrame, truth: DataFrame, per_s1: int = 5) -> DataFrame:
    """Non-matches that share a blocking key (s1_id, key) x (cand_id, key): at most ``per_s1`` each, every candidate once."""
    pairs = s1.join(cands, "key").select("s1_id", "cand_id")
    pairs = pairs.join(truth.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    mix = F.md5(F.concat_ws("|", "s1_id", "cand_id"))
    once = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("cand_id").orderBy(mix, "s1_id"))).where("rn = 1").drop("rn")
    return once.withColumn("rn", F.row_number().over(Window.partitionBy("s1_id").orderBy(mix, "cand_id"))).where(F.col("rn") <= per_s1).drop("rn")


def text_sample(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n texts (column text), those of smallest seeded hash."""
    return records.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "text")), "text").limit(n)
