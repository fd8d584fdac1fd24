"""From scored pairs to match lists: thresholds, singleton rule, one-to-one, lists."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Calibration:
    """Thresholds: a global one, others by country, the singleton rule's tau, and whether a candidate matches once."""

    threshold: float
    by_country: dict[str, float] = field(default_factory=dict)
    singleton_tau: float | None = None
    use_one_to_one: bool = False

    def floor(self) -> float:
        """Smallest threshold of any country: scores below never matter."""
        return min([self.threshold, *self.by_country.values()])

    def to_json(self) -> str:
        d = asdict(self)
        return json.dumps({"global": d.pop("threshold"), **d})

    @classmethod
    def from_json(cls, text: str) -> Calibration:
        d = json.loads(text)
        return cls(d["global"], d.get("by_country") or {}, d.get("singleton_tau"), bool(d.get("use_one_to_one", False)))


def apply_threshold(scored: DataFrame, threshold, prob: str = "prob") -> DataFrame:
    return scored.where(F.col(prob) >= threshold)


def country_threshold(country: Column, default, by_country: dict) -> Column:
    out = F.lit(default)
    for c, t in sorted(by_country.items()):
        out = F.when(country == c, t).otherwise(out)
    return out


def apply_country_thresholds(scored: DataFrame, countries: DataFrame, default, by_country: dict, prob: str = "prob") -> DataFrame:
    """Scored pairs that reach the threshold of their left record's country (entity_id, country); others the default."""
    c = countries.select(F.col("entity_id").alias("s1_id"), F.lower(F.trim("country")).alias("__c"))
    return scored.join(c, "s1_id", "left").where(F.col(prob) >= country_threshold(F.col("__c"), default, by_country)).drop("__c")


def singleton_rule(scored: DataFrame, tau, prob: str = "prob") -> DataFrame:
    """All pairs of left records whose best score reaches tau; the others match nothing."""
    return scored.withColumn("__m", F.max(prob).over(Window.partitionBy("s1_id"))).where(F.col("__m") >= tau).drop("__m")


def one_to_one(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """Each candidate keeps its best left record; ties go to the smaller id."""
    order = Window.partitionBy("cand_id").orderBy(F.desc(prob), "s1_id")
    return scored.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def distinct_pairs(scored: DataFrame) -> DataFrame:
    return scored.select("s1_id", "cand_id").distinct()


def apply_calibration(scored: DataFrame, countries: DataFrame, cal: Calibration, one: bool | None = None, prob: str = "prob") -> DataFrame:
    """Matches (s1_id, cand_id): singleton rule, country thresholds, then one-to-one or distinct."""
    out = scored.where(F.col(prob) >= cal.floor())
    if cal.singleton_tau is not None:
        out = singleton_rule(out, cal.singleton_tau, prob)
    out = apply_country_thresholds(out, countries, cal.threshold, cal.by_country, prob)
    return one_to_one(out, prob).select("s1_id", "cand_id") if (cal.use_one_to_one if one is None else one) else distinct_pairs(out)


def match_lists(matches: DataFrame, s1: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """(source1_entity_id, list) for every left record (s1_id): its candidates sorted and joined by commas, '' without any."""
    lists = matches.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("cand_id")), ",").alias(name))
    return s1.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def candidate_lists(pairs: DataFrame, s1: DataFrame) -> DataFrame:
    return match_lists(pairs, s1, "candidate_entity_ids")


def match_distribution(matches: DataFrame, s1: DataFrame) -> DataFrame:
    """(n_matches, n_records): how many left records have 0, 1, 2, ... matches."""
    per = matches.groupBy("s1_id").agg(F.count("*").alias("n"))
    return s1.select("s1_id").join(per, "s1_id", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n_matches")).agg(F.count("*").alias("n_records"))


def list_row_counts(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: rows of both list tables."""
    a, b = matches.agg(F.count("*").alias("match_rows")), candidates.agg(F.count("*").alias("candidate_rows"))
    return a.crossJoin(F.broadcast(b))  # two single rows
