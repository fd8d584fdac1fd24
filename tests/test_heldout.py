"""Held-out evaluation, hash samples and retrieval recall."""

import json
import random

import pytest

from erlink.operators import ann, metrics, pairs
from erlink.plans import linkage


def test_all_candidates_of_heldout_records_count(spark):
    """A wrong pair that a sample of negatives would have left out lowers the score."""
    cand = spark.createDataFrame([(f"S1-{k}", f"S2-{k}-{j}") for k in range(60) for j in range(5)], "s1_id string, cand_id string")
    truth = spark.createDataFrame([(f"S1-{k}", f"S2-{k}-0") for k in range(60)], "s1_id string, cand_id string")
    held = linkage.heldout_candidates(cand, 0.5)
    ids = {r["s1_id"] for r in pairs.heldout_ids(cand, 0.5).collect()}
    assert 10 < len(ids) < 50 and held.count() == 5 * len(ids)
    scored = held.selectExpr("s1_id", "cand_id", "900L as prob")
    report = {r["variant"]: r["macro_f05"] for r in linkage.heldout_report(scored, cand, truth, [500, 950], 0.5).collect()}
    f = 1.25 * 0.2 / (0.25 * 0.2 + 1)  # one of five right
    assert report["threshold"] == pytest.approx(f, abs=1e-6)


def test_calibration_needs_predictions(spark):
    none = spark.createDataFrame([], "s1_id string, cand_id string, label int, prob long, country string")
    with pytest.raises(ValueError, match="held-out"):
        linkage.tuned(none, [500])


def test_unknown_settings_raise(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"cap": 5, "kap": 1}))
    with pytest.raises(ValueError, match="kap"):
        linkage.Config.load(str(path))
    path.write_text(json.dumps({"cap": 5}))
    assert linkage.Config.load(str(path)).cap == 5


def test_samples_do_not_depend_on_partitioning(spark):
    rows = spark.createDataFrame([(f"S1-{k}", f"S2-{k}", f"t{k}", float(k % 7) / 7) for k in range(200)], "s1_id string, cand_id string, text string, score double")
    for fn in (lambda d: pairs.random_negatives(d, 20), lambda d: pairs.text_sample(d, 20), lambda d: metrics.bootstrap_ci(d, resamples=50)):
        assert sorted(map(str, fn(rows.coalesce(1)).collect())) == sorted(map(str, fn(rows.repartition(7)).collect()))


def test_ivf_recall(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(f"c{k}", [x + rng.gauss(0, 0.3) for x in centres[k % 20]]) for k in range(600)]
    index = spark.createDataFrame(rows, "id string, embedding array<double>")
    queries = spark.createDataFrame([("q" + i, v) for i, v in rows[:40]], "id string, embedding array<double>")
    pick = lambda df: {(r["s1_id"], r["cand_id"]) for r in df.collect()}
    exact = pick(ann.flat_topk(queries, index, 5))
    assert pick(ann.ivf_topk(queries, index, 5, 16, 16)) == exact
    assert len(pick(ann.ivf_topk(queries, index, 5, 16, 8)) & exact) >= 0.9 * len(exact)
