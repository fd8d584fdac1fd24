"""The record-linkage pipeline: prepare, block, audit, features, score, decide, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.functions.constants import MIN_IDF, PAIR_CAP
from erlink.operators import blocking, decide, features, metrics, model, pairs
from erlink.operators.prepare import prepare
from erlink.sources import tables


@dataclass(frozen=True)
class Config:
    """Settings of a run; unknown keys of a JSON file raise."""

    data_dir: str = "data"
    output_dir: str = "output"
    cap: int = PAIR_CAP
    min_idf: float = MIN_IDF
    pass_caps: dict | None = None
    neg_ratio: float = 4.0
    val_share: float = 0.2
    threshold: float = 0.5
    seed: int = 42
    text_sample: int = 1_000_000

    @classmethod
    def load(cls, path: str | None) -> Config:
        import json

        if not path:
            return cls()
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        if unknown := sorted(set(found) - set(cls.__dataclass_fields__)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**found)


def link(s1: DataFrame, cands: DataFrame, cfg: Config, one: bool = True) -> dict[str, DataFrame]:
    """candidates, scored (linear score on native features), matches and lists of two prepared sources."""
    candidates = blocking.generate_candidates(s1, cands, cfg.cap, blocking.caps_of(cfg.pass_caps), cfg.min_idf)
    scored = features.native_features(features.enrich(candidates, s1, cands)).withColumn("prob", model.linear_score())
    scored = scored.select("s1_id", "cand_id", "pass_id", "block_score", "prob")
    kept = decide.apply_threshold(scored, cfg.threshold)
    matches = decide.one_to_one(kept) if one else decide.distinct_pairs(kept)
    ids = s1.select(F.col("entity_id").alias("s1_id"))
    return {"candidates": candidates, "scored": scored, "matches": matches, "lists": decide.match_lists(matches, ids)}


def prepare_split(spark: SparkSession, cfg: Config, split: str) -> dict[str, DataFrame]:
    """Prepared sources 1, 2 and 3 of a split, stored once."""
    at = lambda n: f"{cfg.data_dir}/processed/{split}_source{n}.parquet"
    raw = lambda n: tables.read_records(spark, f"{cfg.data_dir}/{split}/source{n}.tsv")
    return {f"s{n}": tables.stage(spark, at(n), lambda n=n: prepare(raw(n))) for n in (1, 2, 3)}


def block_split(spark: SparkSession, cfg: Config, split: str) -> DataFrame:
    src = prepare_split(spark, cfg, split)
    path = f"{cfg.data_dir}/candidates/{split}_candidates.parquet"
    return tables.stage(spark, path, lambda: blocking.generate_candidates(src["s1"], src["s2"].unionByName(src["s3"]), cfg.cap, blocking.caps_of(cfg.pass_caps), cfg.min_idf))


def truth_of(spark: SparkSession, cfg: Config) -> DataFrame:
    return pairs.explode_truth(tables.read_truth(spark, f"{cfg.data_dir}/train/ground_truth.tsv"))


def vectoriser(spark: SparkSession, cfg: Config) -> DataFrame:
    """The character idf of all runs, fitted once on a sample of the names, romanised names and addresses of the training sources, and stored."""

    def fit() -> DataFrame:
        src = prepare_split(spark, cfg, "train")
        texts = None
        for records in src.values():
            for column in ("name_norm", "name_roman", "addr_norm"):
                part = records.select(F.col(column).alias("text"))
                texts = part if texts is None else texts.unionByName(part)
        return features.fit_char_idf(pairs.text_sample(texts, cfg.text_sample, cfg.seed))

    return tables.stage(spark, f"{cfg.output_dir}/char_idf.parquet", fit)


def features_of(spark: SparkSession, cfg: Config, split: str, chosen: DataFrame) -> DataFrame:
    src = prepare_split(spark, cfg, split)
    return features.all_features(chosen, src["s1"], src["s2"].unionByName(src["s3"]), vectoriser(spark, cfg))


def features_split(spark: SparkSession, cfg: Config, split: str) -> DataFrame:
    """Training pairs with labels, or all candidates of a test split, with all features."""
    cand = block_split(spark, cfg, split)
    make = lambda: features_of(spark, cfg, split, pairs.inference_pairs(cand) if split == "test" else pairs.training_pairs(cand, truth_of(spark, cfg), cfg.neg_ratio))
    return tables.stage(spark, f"{cfg.data_dir}/features/{split}.parquet", make)


def train(spark: SparkSession, cfg: Config) -> DataFrame:
    rows = features_split(spark, cfg, "train")
    fitted, report = model.train_trees(rows, features.FEATURES, cfg.val_share, seed=cfg.seed)
    model.save(fitted, f"{cfg.output_dir}/model")
    return report


def _scored(spark: SparkSession, cfg: Config, split: str, floor: float) -> DataFrame:
    rows = features_split(spark, cfg, split)
    return model.score_trees(model.load(f"{cfg.output_dir}/model"), rows, features.FEATURES, floor)


def heldout_candidates(candidates: DataFrame, val_share: float = 0.2) -> DataFrame:
    """Every candidate pair of the held-out left records, sampled nowhere."""
    return pairs.restrict(candidates, pairs.heldout_ids(candidates, val_share))


def heldout_report(scored: DataFrame, candidates: DataFrame, truth: DataFrame, grid: list, val_share: float = 0.2) -> DataFrame:
    """Best threshold with and without one-to-one over the held-out left records and their full truth; ``scored`` are their candidates with prob."""
    ids = pairs.heldout_ids(candidates, val_share)
    counts = ids.join(truth.distinct().groupBy("s1_id").agg(F.count("*").alias("ntrue")), "s1_id", "left").withColumn("ntrue", F.coalesce("ntrue", F.lit(0)))
    return metrics.compare_decisions(pairs.label_pairs(scored, truth), counts, grid)


def heldout_predictions(spark: SparkSession, cfg: Config, floor: float = 0.2) -> DataFrame:
    """Scores of all candidates of held-out records (stored): the model has seen none of their pairs."""

    def make() -> DataFrame:
        rows = features_of(spark, cfg, "train", heldout_candidates(block_split(spark, cfg, "train"), cfg.val_share))
        return model.score_trees(model.load(f"{cfg.output_dir}/model"), rows, features.FEATURES, floor).select("s1_id", "cand_id", "prob")

    return tables.stage(spark, f"{cfg.output_dir}/heldout_predictions.parquet", make)


def validate(spark: SparkSession, cfg: Config) -> DataFrame:
    """Best threshold with and without one-to-one over all candidates of the held-out records and their full truth."""
    return heldout_report(heldout_predictions(spark, cfg), block_split(spark, cfg, "train"), truth_of(spark, cfg), metrics.thresholds(0.2), cfg.val_share)


def predict(spark: SparkSession, cfg: Config, split: str = "test", one: bool = False, cal: decide.Calibration | None = None) -> dict[str, DataFrame]:
    """Match and candidate lists of a split, written as TSV."""
    src = prepare_split(spark, cfg, split)
    cal = cal or decide.Calibration(cfg.threshold)
    countries = src["s1"].select("entity_id", "country")
    matches = decide.apply_calibration(_scored(spark, cfg, split, cal.floor()), countries, cal, one)
    ids = src["s1"].select(F.col("entity_id").alias("s1_id"))
    out = {"matches": decide.match_lists(matches, ids), "candidates": decide.candidate_lists(block_split(spark, cfg, split), ids), "distribution": decide.match_distribution(matches, ids)}
    tables.write_tsv(out["matches"], f"{cfg.output_dir}/matching_results")
    tables.write_tsv(out["candidates"], f"{cfg.output_dir}/candidate_pairs")
    return out


def audit(spark: SparkSession, cfg: Config) -> DataFrame:
    src = prepare_split(spark, cfg, "train")
    return metrics.blocking_audit(truth_of(spark, cfg), block_split(spark, cfg, "train"), src["s1"].select(F.col("entity_id").alias("s1_id")), src["s2"].unionByName(src["s3"]))


def diagnose(spark: SparkSession, cfg: Config) -> DataFrame:
    cand = block_split(spark, cfg, "train")
    return metrics.oracle_summary(pairs.heldout_ids(cand, cfg.val_share), truth_of(spark, cfg), cand)


def tuned(scored: DataFrame, grid: list, taus: list | None = None) -> decide.Calibration:
    """Thresholds by country and tau of labelled scores (s1_id, cand_id, label, prob, country); ValueError without any."""
    if scored.isEmpty():
        raise ValueError("no held-out predictions to calibrate on: run train and validation first")
    best = metrics.best_threshold(metrics.sweep(scored, grid)).first()["threshold"]
    by = {r["country"]: r["threshold"] for r in metrics.tune_per_country(scored, grid, best).collect()}  # a row per country
    found = metrics.tune_singleton_tau(scored, taus or metrics.TAUS, decide.country_threshold(F.col("country"), best, by))
    tau = found.orderBy(F.desc("macro_f05"), "tau").first()["tau"]
    return decide.Calibration(best, by, tau)


def calibrate(spark: SparkSession, cfg: Config) -> decide.Calibration:
    """Thresholds by country and tau, tuned on the predictions of held-out records only."""
    countries = prepare_split(spark, cfg, "train")["s1"].select(F.col("entity_id").alias("s1_id"), "country")
    scored = pairs.label_pairs(heldout_predictions(spark, cfg), truth_of(spark, cfg)).join(countries, "s1_id")
    return tuned(scored.select("s1_id", "cand_id", "label", "prob", "country"), metrics.thresholds())


def leave_one_out(spark: SparkSession, cfg: Config) -> dict[str, DataFrame]:
    """Per country the best sweep row of a model that was trained without it."""
    countries = prepare_split(spark, cfg, "train")["s1"].select(F.col("entity_id").alias("s1_id"), "country")
    rows = features_split(spark, cfg, "train").join(countries, "s1_id")
    names = [r["country"] for r in countries.groupBy("country").count().orderBy("country").collect()]  # a row per country
    return model.leave_one_out(rows, features.FEATURES, names)
