"""Evaluation: entity-level F0.5, threshold sweeps, recall ceilings, audits, ranking metrics.

Entity scores are quantised to 1e-6 before they are added up, so that a mean
does not depend on the order of rows or partitions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SWEEP_LOW, SWEEP_HIGH, SWEEP_STEP = 0.05, 0.95, 0.025
MIN_COUNTRY_ENTITIES = 5000
TAUS = [round(0.30 + 0.01 * i, 2) for i in range(70)]


def f05(ntrue: Column, npred: Column, tp: Column) -> Column:
    """F0.5 of one entity; 1 where nothing is true and nothing predicted."""
    n, p, t = (c.cast("double") for c in (ntrue, npred, tp))
    precision, recall = t / p, t / n
    score = F.lit(1.25) * precision * recall / (F.lit(0.25) * precision + recall)
    return F.when(ntrue == 0, F.when(npred == 0, 1.0).otherwise(0.0)).when((npred == 0) | (tp == 0), 0.0).otherwise(score)


def quantised(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5).cast("long")


def mean_of(c: Column) -> Column:
    """Mean of quantised values; null over no rows."""
    return F.try_divide(F.sum(quantised(c)).cast("double"), F.count("*") * F.lit(1e6))


def entity_counts(universe: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(s1_id, ntrue, npred, tp) of every id of the universe; pairs count once."""
    t = truth.select("s1_id", "cand_id").distinct().withColumn("t", F.lit(1))
    p = predicted.select("s1_id", "cand_id").distinct().withColumn("p", F.lit(1))
    per = t.join(p, ["s1_id", "cand_id"], "full_outer").groupBy("s1_id").agg(F.count("t").alias("ntrue"), F.count("p").alias("npred"), F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"))
    return universe.select("s1_id").distinct().join(per, "s1_id", "left").select("s1_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ntrue", "npred", "tp")])


def entity_scores(counts: DataFrame) -> DataFrame:
    return counts.withColumn("score", f05(F.col("ntrue"), F.col("npred"), F.col("tp")))


def macro_f05(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: mean F0.5 over all ids of truth (s1_id, cand_id; null cand_id for singletons) and predictions; 0 without any."""
    universe = truth.select("s1_id").union(predicted.select("s1_id"))
    scored = entity_scores(entity_counts(universe, truth.where("cand_id is not null"), predicted.where("cand_id is not null")))
    return scored.agg(F.count("*").alias("n_entities"), F.coalesce(mean_of(F.col("score")), F.lit(0.0)).alias("macro_f05"))


def row_f05(rows: DataFrame, threshold, prob: str = "prob") -> DataFrame:
    """One row: mean F0.5 over the groups present in labelled rows (s1_id, label, prob)."""
    hit = F.col(prob) >= threshold
    per = rows.groupBy("s1_id").agg(F.sum("label").alias("ntrue"), F.count(F.when(hit, 1)).alias("npred"), F.count(F.when(hit & (F.col("label") == 1), 1)).alias("tp"))
    return entity_scores(per).agg(F.count("*").alias("n_entities"), F.coalesce(mean_of(F.col("score")), F.lit(0.0)).alias("macro_f05"))


def thresholds(low: float = SWEEP_LOW, high: float = SWEEP_HIGH, step: float = SWEEP_STEP) -> list[float]:
    return [low + step * i for i in range(int(round((high - low) / step)) + 1)]


def _binned(rows: DataFrame, grid: list, prob: str) -> DataFrame:
    """Number of thresholds that each row's score reaches."""
    reached = F.when(F.col(prob) >= grid[-1], len(grid))
    for k in range(len(grid) - 1, 0, -1):
        reached = reached.when(F.col(prob) >= grid[k - 1], k)
    return rows.withColumn("bin", reached.otherwise(0))


def sweep(rows: DataFrame, grid: list, prob: str = "prob", by: list[str] | None = None, ntrue: DataFrame | None = None) -> DataFrame:
    """(by, threshold, n_entities, macro_f05) over a grid of ascending thresholds.

    One aggregation: rows are counted per entity and bin, running sums from the
    highest bin down give every threshold's counts, so rows are never repeated
    per threshold.  Without ``ntrue`` (s1_id, ntrue[, by]) an entity's truth is
    its labelled rows, and only entities with rows count.
    """
    by = by or []
    per = _binned(rows, grid, prob).groupBy(*by, "s1_id", "bin").agg(F.count("*").alias("n"), F.sum("label").alias("t"))
    entities = rows.groupBy(*by, "s1_id").agg(F.sum("label").alias("ntrue")) if ntrue is None else ntrue
    # a dense entity x threshold frame: grid is a short fixed list
    dense = entities.select(*by, "s1_id", "ntrue", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "threshold")).withColumn("bin", F.col("i") + 1)
    joined = dense.join(per.where("bin > 0"), [*by, "s1_id", "bin"], "left")
    down = Window.partitionBy(*by, "s1_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    counted = joined.withColumn("npred", F.sum(F.coalesce("n", F.lit(0))).over(down)).withColumn("tp", F.sum(F.coalesce("t", F.lit(0))).over(down))
    return entity_scores(counted).groupBy(*by, "threshold").agg(F.count("*").alias("n_entities"), mean_of(F.col("score")).alias("macro_f05"))


def best_threshold(swept: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best threshold; ties go to the lowest."""
    best = F.min(F.struct((-F.col("macro_f05")).alias("s"), F.col("threshold").alias("t"))).alias("b")
    grouped = swept.groupBy(*by) if by else swept.groupBy()
    return grouped.agg(best).select(*(by or []), F.col("b.t").alias("threshold"), (-F.col("b.s")).alias("macro_f05"))


def score_bin(prob: Column, low: float, step: float, n: int) -> Column:
    """Index of the score's bin above ``low``; null below."""
    return F.when(prob >= low, F.least(F.floor((prob - low) / step + 1e-9).cast("int"), F.lit(n - 1)))


def tune_per_country(rows: DataFrame, grid: list, default, prob: str = "prob", least: int = MIN_COUNTRY_ENTITIES) -> DataFrame:
    """(country, threshold) from labelled rows (country, s1_id, label, prob); the default where a country is small or has one label only."""
    size = rows.groupBy("country").agg(F.countDistinct("s1_id").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    best = best_threshold(sweep(rows, grid, prob, ["country"]), ["country"])
    out = size.join(best, "country", "left")
    return out.select("country", F.when((F.col("n") < least) | (F.col("lo") == F.col("hi")), F.lit(default)).otherwise(F.col("threshold")).alias("threshold"))


def tune_singleton_tau(rows: DataFrame, taus: list, threshold: Column, prob: str = "prob") -> DataFrame:
    """(tau, macro_f05) per tau: a group keeps its rows at or above ``threshold`` if its best score reaches tau."""
    hit = F.col(prob) >= threshold
    per = rows.groupBy("s1_id").agg(F.max(prob).alias("best"), F.sum("label").alias("ntrue"), F.count(F.when(hit, 1)).alias("np"), F.count(F.when(hit & (F.col("label") == 1), 1)).alias("t"))
    kept = lambda c: F.when(F.col("best") >= F.col("tau"), F.col(c)).otherwise(0)
    each = per.withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus]))).withColumn("npred", kept("np")).withColumn("tp", kept("t"))
    return entity_scores(each).groupBy("tau").agg(mean_of(F.col("score")).alias("macro_f05"))


def recall_ceiling(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: truth pairs, those among the candidates, their share."""
    found = truth.join(candidates.select("s1_id", "cand_id").distinct().withColumn("f", F.lit(1)), ["s1_id", "cand_id"], "left")
    return found.agg(F.count("*").alias("n_truth"), F.count("f").alias("n_found")).withColumn("recall", F.try_divide("n_found", "n_truth"))


def oracle_counts(universe: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1_id, ntrue, nfound, score): what a perfect matcher reaches on these candidates; 1 without truth."""
    t = truth.select("s1_id", "cand_id").distinct()
    found = t.join(candidates.select("s1_id", "cand_id").distinct().withColumn("f", F.lit(1)), ["s1_id", "cand_id"], "left").groupBy("s1_id").agg(F.count("*").alias("ntrue"), F.count("f").alias("nfound"))
    out = universe.select("s1_id").distinct().join(found, "s1_id", "left").select("s1_id", F.coalesce("ntrue", F.lit(0)).alias("ntrue"), F.coalesce("nfound", F.lit(0)).alias("nfound"))
    recall = F.col("nfound").cast("double") / F.col("ntrue")
    return out.withColumn("score", F.when(F.col("ntrue") == 0, 1.0).when(F.col("nfound") == 0, 0.0).otherwise(F.lit(1.25) * recall / (F.lit(0.25) + recall)))


def oracle_summary(universe: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: entities, truth and found pairs, entities with nothing found, mean entity recall, oracle F0.5."""
    per = oracle_counts(universe, truth, candidates)
    recall = F.col("nfound").cast("double") / F.col("ntrue")
    has = F.col("ntrue") > 0
    return per.agg(
        F.count("*").alias("n_entities"), F.sum("ntrue").alias("n_truth"), F.sum("nfound").alias("n_found"), F.try_divide(F.sum("nfound"), F.sum("ntrue")).alias("pair_recall"),
        F.count(F.when(has & (F.col("nfound") == 0), 1)).alias("n_none_found"), F.try_divide(F.sum(F.when(has, quantised(recall))).cast("double"), F.count(F.when(has, 1)) * F.lit(1e6)).alias("mean_entity_recall"),
        mean_of(F.col("score")).alias("oracle_f05"),
    )


def recall_by(truth: DataFrame, candidates: DataFrame, countries: DataFrame) -> DataFrame:
    """(country, n_truth, n_found, recall) by the left record's country; records without one are left out."""
    found = truth.join(candidates.select("s1_id", "cand_id").distinct().withColumn("f", F.lit(1)), ["s1_id", "cand_id"], "left")
    c = countries.where("country is not null").select(F.col("entity_id").alias("s1_id"), "country")
    return found.join(c, "s1_id").groupBy("country").agg(F.count("*").alias("n_truth"), F.count("f").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_truth"))


def pass_recall(truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """(pass_id, n_found, recall): truth pairs that each pass present among the candidates found, of all truth pairs."""
    n = truth.agg(F.count("*").alias("n"))
    passes = candidates.select("pass_id").distinct()
    found = truth.join(candidates.select("s1_id", "cand_id", "pass_id").distinct(), ["s1_id", "cand_id"]).groupBy("pass_id").agg(F.count("*").alias("f"))
    out = passes.join(found, "pass_id", "left").crossJoin(F.broadcast(n))  # one row is broadcast
    return out.select("pass_id", F.coalesce("f", F.lit(0)).alias("n_found"), F.try_divide(F.coalesce("f", F.lit(0)), "n").alias("recall"))


def blocking_audit(truth: DataFrame, candidates: DataFrame, s1: DataFrame, n_candidate_records: DataFrame) -> DataFrame:
    """One row: recall, candidates per left record, the same over singletons, and candidates per candidate record."""
    head = recall_ceiling(truth, candidates)
    per = candidates.groupBy("s1_id").agg(F.count("*").alias("n"))
    single = s1.select("s1_id").distinct().join(truth.select("s1_id").distinct().withColumn("has", F.lit(1)), "s1_id", "left")
    each = per.join(single, "s1_id").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_with"), F.sum(F.when(F.col("has").isNull(), F.col("n"))).alias("sp"), F.count(F.when(F.col("has").isNull(), 1)).alias("sn"))
    total = n_candidate_records.agg(F.count("*").alias("records"))
    row = head.crossJoin(F.broadcast(each)).crossJoin(F.broadcast(total))  # single rows
    return row.select("n_truth", "n_found", "recall", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.try_divide("n_pairs", "n_with").alias("candidates_per_s1"), F.try_divide("sp", "sn").alias("candidates_per_singleton"), F.try_divide("n_pairs", "records").alias("reduction_ratio"))


def score_calibration(scored: DataFrame, truth: DataFrame, universe: DataFrame, countries: DataFrame, matches: DataFrame) -> DataFrame:
    """(country, n_entities, macro_f05) of matches, with a row 'all'; every id of the universe counts."""
    per = entity_scores(entity_counts(universe, truth, matches)).join(countries.select(F.col("entity_id").alias("s1_id"), F.lower(F.trim("country")).alias("country")), "s1_id", "left")
    # the explode gives each entity its country's row and the total's
    return per.withColumn("country", F.explode(F.array(F.coalesce("country", F.lit("")), F.lit("all")))).groupBy("country").agg(F.count("*").alias("n_entities"), mean_of(F.col("score")).alias("macro_f05"))


def pair_quality(scored: DataFrame, threshold, prob: str = "prob") -> DataFrame:
    """One row over labelled pairs: predicted, right, pair precision and recall, false merges on entities without a true pair."""
    per = scored.withColumn("any", F.max("label").over(Window.partitionBy("s1_id")))
    hit = F.col(prob) >= threshold
    n = lambda c: F.count(F.when(c, 1))
    out = per.agg(n(hit).alias("n_pred"), n(hit & (F.col("label") == 1)).alias("n_right"), F.sum("label").alias("n_true"), n(hit & (F.col("any") == 0)).alias("false_merges"))
    return out.withColumn("precision", F.try_divide("n_right", "n_pred")).withColumn("recall", F.try_divide("n_right", "n_true"))


def compare_decisions(scored: DataFrame, truth_counts: DataFrame, grid: list, prob: str = "prob") -> DataFrame:
    """(variant, threshold, macro_f05): best of the plain sweep and of the sweep after one-to-one."""
    from erlink.operators.decide import one_to_one

    plain = best_threshold(sweep(scored, grid, prob, ntrue=truth_counts)).withColumn("variant", F.lit("threshold"))
    single = best_threshold(sweep(one_to_one(scored, prob), grid, prob, ntrue=truth_counts)).withColumn("variant", F.lit("one_to_one"))
    return plain.unionByName(single).select("variant", "threshold", "macro_f05")


def _score_groups(rows: DataFrame, prob: str) -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the highest score down and from the lowest up.

    Totals run over score ranges first, so no task sorts all scores.
    """
    per = rows.groupBy(F.col(prob).alias("p")).agg(F.sum("label").alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg"))
    part = F.floor(F.col("p") * 64)
    per = per.withColumn("part", part)
    chunk = per.groupBy("part").agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"))
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 65 rows for scores in 0..1
    chunk = chunk.select("part", F.coalesce(F.sum("cp").over(up), F.lit(0)).alias("bp"), F.coalesce(F.sum("cn").over(up), F.lit(0)).alias("bn"))
    inside = Window.partitionBy("part").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    out = per.join(F.broadcast(chunk), "part")
    return out.select("p", "pos", "neg", (F.col("bp") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("pos_below"), (F.col("bn") + F.coalesce(F.sum("neg").over(inside), F.lit(0))).alias("neg_below"))


def auc(rows: DataFrame, prob: str = "prob") -> DataFrame:
    """One row: area under the ROC curve; ties count half, null with one label only."""
    g = _score_groups(rows, prob)
    wins = F.sum(F.col("pos") * (2 * F.col("neg_below") + F.col("neg"))).cast("double")
    return g.agg(F.try_divide(wins, 2.0 * F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(rows: DataFrame, prob: str = "prob") -> DataFrame:
    """One row: mean over positives of the precision at their score."""
    g = _score_groups(rows, prob).where("pos > 0")
    total = rows.agg(F.sum("label").alias("tp"), F.count(F.when(F.col("label") == 0, 1)).alias("tn"))
    g = g.crossJoin(F.broadcast(total))  # one row is broadcast
    above_pos, above_neg = F.col("tp") - F.col("pos_below"), F.col("tn") - F.col("neg_below")
    term = F.floor(F.col("pos") * (above_pos.cast("double") / (above_pos + above_neg)) * 1e6 + 0.5).cast("long")
    return g.agg(F.try_divide(F.sum(term).cast("double"), F.max("tp") * F.lit(1e6)).alias("average_precision"))


#: Chances of 0, 1, ... under a Poisson law of mean 1, summed up, in 2**32ths.
POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(13)]


def bootstrap_ci(scores: DataFrame, column: str = "score", resamples: int = 500, key: str = "s1_id") -> DataFrame:
    """One row: mean and its 95 % interval by Poisson bootstrap; each resample is a weighted sum, so scores stay where they are.

    A row's weight in a resample follows from a hash of its key, so the
    interval doesn't depend on partitioning; scores are added in millionths.
    """
    import pandas as pd

    def run(batches):
        w, s = np.zeros(resamples, dtype=np.int64), np.zeros(resamples, dtype=np.int64)
        at = np.arange(resamples, dtype=np.int64)[:, None]
        for b in batches:
            h, x = b["h"].to_numpy(np.int64), b["x"].to_numpy(np.int64)
            for k in range(0, len(x), 10_000):
                u = (h[None, k : k + 10_000] * (2 * at + 1) + at * 2654435761) & 0xFFFFFFFF
                weight = np.searchsorted(np.array(POISSON), u, side="right")
                w += weight.sum(1)
                s += weight @ x[k : k + 10_000]
        yield pd.DataFrame({"i": np.arange(resamples), "w": w, "s": s})

    rows = scores.select(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long").alias("h"), quantised(F.col(column)).alias("x"))
    means = rows.mapInPandas(run, "i int, w bigint, s bigint").groupBy("i").agg((F.sum("s").cast("double") / F.sum("w").cast("double") / 1e6).alias("m"))
    interval = means.agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))
    return scores.agg(mean_of(F.col(column)).alias("mean")).crossJoin(F.broadcast(interval))
