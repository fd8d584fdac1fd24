"""Unit cases of blocking, pairs, features, retrieval, decisions, metrics, checks and files."""

import random

import pytest
from pyspark.sql import functions as F

from erlink.operators import ann, blocking, decide, features, metrics, model, pairs, quality
from erlink.sources import tables

KEYED = "entity_id string, name_norm string, name_script string, house_no string, postal string, state_key string, name_tokens array<string>, street_tokens array<string>"


def pair_set(df):
    return {(r["s1_id"], r["cand_id"]) for r in df.collect()}


def records(spark, rows):
    return spark.createDataFrame([(i, n, "latin", h, p, s, n.split(), st) for i, n, h, p, s, st in rows], KEYED)


def test_exact_name_is_pass_one_and_caps_hold(spark):
    s1 = records(spark, [("S1-1", "best bakery", "10", "78701", "texas", ["main"])])
    cands = records(spark, [(f"S2-{i:03d}", "best bakery", "10", "78701", "texas", ["main"]) for i in range(300)])
    got = blocking.generate_candidates(s1, cands, cap=50).collect()
    assert len(got) == 50 and {r["pass_id"] for r in got} == {1} and all(r["is_s2"] for r in got)
    none = blocking.generate_candidates(s1, cands, caps=dict.fromkeys(range(1, 11), 100))
    assert none.count() == 0


def test_block_keys(spark):
    r = records(spark, [("a", "alpha beta", "7", "12345", "texas", ["mainstreet", "x"]), ("b", "", "", "", "", [])])
    idf = spark.createDataFrame([("alpha", 5.0), ("beta", 1.0)], "token string, idf double")
    got = {(x["entity_id"], x["pass_id"], x["key"]) for x in blocking.block_keys(r, idf).collect()}
    assert got == {("a", 1, "alpha beta"), ("a", 3, "alpha"), ("a", 4, "7|mains"), ("a", 5, "12345|alpha"), ("a", 7, "alpha"), ("a", 8, "mains"), ("a", 9, "alpha|beta")}
    plain = {(x["pass_id"], x["key"]) for x in blocking.block_keys(r).collect()}
    assert (6, "texas|alp") in plain and not any(p == 3 for p, _ in plain)


def test_pairs(spark):
    truth = pairs.explode_truth(spark.createDataFrame([("S1-1", "S2-1,S3-9"), ("S1-2", "")], "source1_entity_id string, matched_entity_ids string"))
    assert pair_set(truth) == {("S1-1", "S2-1"), ("S1-1", "S3-9")}
    cand = spark.createDataFrame([(f"S1-{i}", f"S2-{j}") for i in range(40) for j in range(3)], "s1_id string, cand_id string")
    assert {(r["s1_id"], r["cand_id"]) for r in pairs.label_pairs(cand, truth).where("label = 1").collect()} == {("S1-1", "S2-1")}
    assert pairs.negatives(cand, truth).count() == 119 and pairs.random_negatives(pairs.negatives(cand, truth), 7).count() == 7
    split = pairs.grouped_split(cand, 0.5).groupBy("s1_id").agg(F.countDistinct("is_val").alias("n"), F.max("is_val").alias("v")).collect()
    assert all(r["n"] == 1 for r in split) and 0.2 < sum(r["v"] for r in split) / 40 < 0.8
    assert pairs.sample_share(10, 100, 4) == 40 and pairs.sample_share(0, 100, 4) == 1e-4


def test_feature_merge_and_defaults(spark):
    f = spark.createDataFrame([("a", "x", 0.3), ("a", "y", 0.4)], "s1_id string, cand_id string, name_e5_cos double")
    cos = spark.createDataFrame([("a", "x", 0.9, 0.8, 0.7)], "s1_id string, cand_id string, name_e5_cos double, addr_e5_cos double, entity_e5_cos double")
    got = {r["cand_id"]: r for r in features.merge_cosine(f, features.import_cosine(cos)).collect()}
    assert got["x"]["name_e5_cos"] == 0.9 and got["y"]["addr_e5_cos"] == -1.0 and len(got["x"]) == 5
    with pytest.raises(ValueError):
        features.import_cosine(f)
    assert features.with_defaults(f).first()["ret_rank"] == -1.0


def test_char_cosine_orders(spark):
    t = spark.createDataFrame([("best bakery",), ("best bakerys",), ("iron works",), ("ab",)], "text string")
    idf = features.fit_char_idf(t)
    p = spark.createDataFrame([(1, "best bakery", "best bakerys"), (2, "best bakery", "iron works"), (3, "ab", "ab")], "k int, a string, b string")
    got = {r["k"]: r["c"] for r in features.char3_cosine(p, features.char_vectors(t, idf), "a", "b", "c").collect()}
    assert got[1] > 0.8 > got[2] and got[3] == 0.0


def test_flat_top_k(spark):
    c = spark.createDataFrame([("c0", [1.0, 0.0, 0.0]), ("c1", [0.0, 1.0, 0.0]), ("c2", [1.0, 1.0, 0.0]), ("c3", [-1.0, 0.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "id string, embedding array<float>")
    got = [(r["cand_id"], r["rank"]) for r in ann.flat_topk(q, c, 3).orderBy("rank").collect()]
    assert got == [("c0", 0), ("c2", 1), ("c1", 2)] and ann.flat_topk(q, c.limit(0), 3).count() == 0


def test_union_and_attribution(spark):
    P = "s1_id string, cand_id string"
    lex = spark.createDataFrame([("a", "S2-1", 3, 0.5)], P + ", pass_id int, block_score double")
    found = spark.createDataFrame([("a", "S2-1", "addr"), ("a", "S3-2", "addr"), ("a", "S2-3", "entity"), ("a", "S2-4", "new")], P + ", channel string")
    got = {r["cand_id"]: (r["pass_id"], r["block_score"], r["is_s2"]) for r in ann.union_with_lexical(found, lex).collect()}
    assert got == {"S2-1": (3, 0.5, True), "S3-2": (12, 0.85, False), "S2-3": (13, 0.8, True), "S2-4": (11, 0.5, True)}
    make = lambda *t: spark.createDataFrame([(x, x) for x in t], P)
    r = ann.channel_attribution(make("t1", "t2", "t3"), make("t1"), {"name": make("t2"), "addr": make("t2", "t3")}).first()
    assert tuple(r[c] for c in ("truth", "lexical_found", "lexical_missed", "name", "addr", "any", "multiple", "none")) == (3, 1, 2, 1, 2, 2, 1, 0)


S = "s1_id string, cand_id string, prob double"


def test_decisions(spark):
    scored = spark.createDataFrame([("S1-1", "S2-1", 0.96), ("S1-1", "S2-2", 0.93), ("S1-2", "S3-1", 0.93), ("S1-3", "S2-3", 0.96)], S)
    countries = spark.createDataFrame([("S1-1", "US"), ("S1-2", "India"), ("S1-3", "France")], "entity_id string, country string")
    cal = decide.Calibration(0.95, {"us": 0.95, "india": 0.925})
    ids = countries.select(F.col("entity_id").alias("s1_id"))
    lists = {r[0]: r[1] for r in decide.match_lists(decide.apply_calibration(scored, countries, cal), ids).collect()}
    assert lists == {"S1-1": "S2-1", "S1-2": "S3-1", "S1-3": "S2-3"}
    low = spark.createDataFrame([("S1-1", "S2-1", 0.4), ("S1-2", "S2-2", 0.6)], S)
    assert pair_set(decide.apply_calibration(low, countries, decide.Calibration(0.3, singleton_tau=0.5))) == {("S1-2", "S2-2")}
    same = spark.createDataFrame([("S1-1", "S2-1", 0.9), ("S1-2", "S2-1", 0.6), ("S1-3", "S2-1", 0.9)], S)
    assert pair_set(decide.one_to_one(same)) == {("S1-1", "S2-1")}
    assert decide.Calibration.from_json(cal.to_json()) == cal and decide.Calibration.from_json('{"global": 0.7}') == decide.Calibration(0.7) and cal.floor() == 0.925


def reference_f(ntrue, npred, tp):
    if ntrue == 0:
        return float(npred == 0)
    if not npred or not tp:
        return 0.0
    p, r = tp / npred, tp / ntrue
    return 1.25 * p * r / (0.25 * p + r)


def test_entity_scores(spark):
    df = spark.createDataFrame([(2, 3, 2), (0, 0, 0), (1, 0, 0), (0, 1, 0)], "ntrue int, npred int, tp int")
    got = [r["score"] for r in metrics.entity_scores(df).collect()]
    assert got == pytest.approx([0.714286, 1, 0, 0], abs=1e-6)
    truth = spark.createDataFrame([("a", "S2-1"), ("a", "S3-1"), ("b", None)], "s1_id string, cand_id string")
    pred = spark.createDataFrame([("a", "S2-1"), ("a", "S2-2"), ("a", "S3-1")], "s1_id string, cand_id string")
    assert metrics.macro_f05(truth, pred).first()["macro_f05"] == pytest.approx((0.714286 + 1) / 2, abs=1e-6)
    assert metrics.macro_f05(truth.limit(0), pred.limit(0)).first()["macro_f05"] == 0.0


def test_sweep_equals_brute_force(spark):
    rng = random.Random(0)
    rows = [(f"e{rng.randrange(120)}", f"c{i}", rng.random(), int(rng.random() < 0.3)) for i in range(800)]
    df = spark.createDataFrame(rows, S + ", label int")
    grid = metrics.thresholds()
    assert len(grid) == 37
    got = {r["threshold"]: r["macro_f05"] for r in metrics.sweep(df, grid).collect()}
    for t in grid:
        per = {}
        for e, _, p, y in rows:
            x = per.setdefault(e, [0, 0, 0])
            x[0] += y
            x[1] += p >= t
            x[2] += y and p >= t
        assert got[t] == pytest.approx(sum(reference_f(*x) for x in per.values()) / len(per), abs=2e-6)
    best = metrics.best_threshold(metrics.sweep(df, grid)).first()
    assert best["threshold"] == min(t for t in grid if got[t] == max(got.values()))


def test_row_form_and_tau(spark):
    rows = lambda last: spark.createDataFrame([("1", "a", 0.9, 1), ("1", "b", 0.1, 0), ("2", "c", last, 0)], S + ", label int")
    assert metrics.row_f05(rows(0.1), 0.5).first()["macro_f05"] == 1.0 and metrics.row_f05(rows(0.9), 0.5).first()["macro_f05"] == 0.5
    tau = metrics.tune_singleton_tau(spark.createDataFrame([("E1", "a", 0.9, 1), ("E2", "b", 0.35, 0), ("E2", "c", 0.3, 0)], S + ", label int"), metrics.TAUS, F.lit(0.2))
    best = tau.orderBy(F.desc("macro_f05"), "tau").first()
    assert best["tau"] > 0.35 and best["macro_f05"] == 1.0


def test_country_tuning_falls_back(spark):
    rows = [("us", f"u{i}", f"c{i}", 0.8 if i % 2 else 0.6, i % 2) for i in range(8)] + [("france", "f1", "x", 0.9, 1)]
    got = {r["country"]: r["threshold"] for r in metrics.tune_per_country(spark.createDataFrame(rows, "country string, " + S + ", label int"), metrics.thresholds(), 0.7, least=5).collect()}
    assert got["france"] == 0.7 and 0.6 < got["us"] <= 0.8


def test_oracle_audit_and_ranking(spark):
    P = "s1_id string, cand_id string"
    truth = spark.createDataFrame([("1", "S2-1"), ("1", "S3-1"), ("2", "S2-9")], P)
    cand = spark.createDataFrame([("1", "S2-1"), ("1", "S2-7")], P)
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "s1_id string")
    got = {r["s1_id"]: r["score"] for r in metrics.oracle_counts(ids, truth, cand).collect()}
    assert got == {"1": pytest.approx(0.83333, abs=1e-4), "2": 0.0, "3": 1.0}
    assert metrics.recall_ceiling(truth, cand).first()["recall"] == pytest.approx(1 / 3)
    a = metrics.blocking_audit(truth, cand, ids, cand).first()
    assert (a["n_pairs"], a["candidates_per_s1"], a["reduction_ratio"]) == (2, 2.0, 1.0)
    rng = random.Random(1)
    rows = [("s", str(i), round(rng.random(), 2), int(rng.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame(rows, S + ", label int")
    pos, neg = [p for *_, p, y in rows if y], [p for *_, p, y in rows if not y]
    want = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / len(pos) / len(neg)
    assert metrics.auc(df).first()["auc"] == pytest.approx(want)
    ap = sum(sum(x >= p for x in pos) / sum(r[2] >= p for r in rows) for p in pos) / len(pos)
    assert metrics.average_precision(df).first()["average_precision"] == pytest.approx(ap, abs=1e-5)
    ci = metrics.bootstrap_ci(spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "s1_id long, score double")).first()
    assert ci["ci_low"] < 0.5 < ci["ci_high"] and ci["ci_high"] - ci["ci_low"] < 0.2


def test_list_checks(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-2", "S1-3"), ("S1-2", ""), ("S1-9", "X"), ("S1-4", "S3-77")], "s1_id string, ids string")
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",), ("S1-4",)], "s1_id string")
    known = spark.createDataFrame([("S2-1",)], "id string")
    found = quality.validate_lists(lists, required, known)
    assert {(r["rule"], r["offender"]) for r in found.collect()} == {("duplicate_row", "S1-2"), ("duplicate_id", "S1-1"), ("self_match", "S1-3"), ("wrong_prefix", "X"), ("missing_row", "S1-3"), ("unexpected_row", "S1-9"), ("unknown_id", "S3-77")}
    assert quality.list_summary(lists, found).first()["verdict"] == "FAIL"
    head = ("source1_entity_id", "matched_entity_ids")
    assert quality.check_header([], head) == ["empty file"] and "COMMA" in quality.check_header(["a,b"], head)[0] and not quality.check_header(["Source1_Entity_ID\t matched_entity_ids \n"], head)


def test_files_round_trip(spark, tmp_path):
    src = tmp_path / "s.tsv"
    src.write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tBest \"Bakery\"\t\tUS\n", encoding="utf-8")
    r = tables.read_records(spark, str(src)).first()
    assert (r["business_name"], r["business_address"]) == ('Best "Bakery"', "")
    out = spark.createDataFrame([("S1-1", ""), ("S1-2", "S2-1,S3-1")], "source1_entity_id string, matched_entity_ids string")
    tables.write_tsv(out.coalesce(1), str(tmp_path / "o"))
    lines = next((tmp_path / "o").glob("part-*")).read_text().splitlines()
    assert lines == ["source1_entity_id\tmatched_entity_ids", "S1-1\t", "S1-2\tS2-1,S3-1"]
    assert {tuple(x) for x in tables.read_truth(spark, str(tmp_path / "o")).collect()} == {("S1-1", ""), ("S1-2", "S2-1,S3-1")}
    calls = []
    make = lambda: calls.append(1) or out
    assert tables.stage(spark, str(tmp_path / "st"), make).count() == tables.stage(spark, str(tmp_path / "st"), make).count() == 2 and calls == [1]


def test_stream_prepares_new_files(spark, tmp_path):
    from erlink.streaming.prepare import prepared_stream, write_stream

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"f{k}.tsv").write_text(f"entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-{k}\tBest Bakery\t\tUS\n")
        write_stream(prepared_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["entity_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"S2-0", "S2-1"}


def test_linear_score_and_trees(spark):
    row = spark.createDataFrame([(1.0, 1.0, 1, -1.0, 1, 1, 1)], "name_jaccard double, name_containment double, name_exact int, addr_jaccard double, house_match int, postal_exact int, same_country int")
    assert row.select(model.linear_score().alias("p")).first()["p"] == pytest.approx(0.85)
    rng = random.Random(2)
    rows = [(f"s{i % 60}", f"c{i}", y := int(rng.random() < 0.5), y * 0.6 + rng.random() * 0.5) for i in range(400)]
    fitted, report = model.train_trees(spark.createDataFrame(rows, "s1_id string, cand_id string, label int, f double"), ["f"], trees=3, depth=2)
    assert report.first()["auc"] > 0.8 and fitted.numFeatures == 1


def test_all_features(spark):
    s1 = records(spark, [("S1-1", "best bakery", "10", "78701", "texas", ["main"])])
    cands = records(spark, [("S2-1", "best bakery", "10", "78701", "texas", ["main"]), ("S3-2", "iron works", "", "", "", [])])
    extra = lambda r: r.select("*", F.col("name_norm").alias("name_fold"), F.col("name_norm").alias("name_roman"), F.col("name_norm").alias("addr_norm"), F.lit(False).alias("addr_raw_missing"), F.lit(True).alias("landmark_flag"), F.lit("us").alias("country"))
    s1, cands = extra(s1), extra(cands)
    p = spark.createDataFrame([("S1-1", "S2-1", 1, 1.0, True), ("S1-1", "S3-2", 3, 4.5, False)], "s1_id string, cand_id string, pass_id int, block_score double, is_s2 boolean")
    idf = features.fit_char_idf(cands.select(F.col("name_norm").alias("text")))
    out = features.all_features(p, s1, cands, idf)
    assert out.columns == ["s1_id", "cand_id", *features.FEATURES]
    got = {r["cand_id"]: r for r in out.collect()}
    same, other = got["S2-1"], got["S3-2"]
    assert same["name_ratio"] == 100 and same["name_char3_cos"] == pytest.approx(1.0) and same["house_match"] == 1 and same["s1_degree"] == 2
    assert other["name_char3_cos"] == 0.0 and other["name_jaccard"] == 0 and other["name_e5_cos"] == -1.0 and same["name_wratio"] == 100
