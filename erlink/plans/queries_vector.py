"""Queries over vector retrieval: the vectors whose id is divisible by 100 against all other rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from erlink.operators import ann, blocking, features, pairs
from erlink.operators.metrics import quantised
from erlink.operators.model import LINEAR, linear_score
from erlink.plans import linkage
from erlink.plans.linkage import Config, link
from erlink.plans.queries_block import _GRAMS, NATIVE
from erlink.plans.queries_eval import GRID, plain_sweep
from erlink.plans.registry import query
from erlink.plans.roles import BLOCKED, Hosts, read

K = 5
# scores are compared in millionths: engines add up products in different orders
_Q = "CAST(floor(1e6 * {0} + 0.5e0) AS BIGINT) AS {0}"


def _in_millionths(df, *names):
    return df.withColumns({n: quantised(F.col(n)) for n in names})


_UNIT = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / CASE WHEN sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) = 0 THEN 1e0 ELSE sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) END)"
_VECTORS = f"v AS (SELECT vec_id, label, {_UNIT} AS u FROM embeddings)"
_TOP = f"""{_VECTORS}, sc AS (SELECT 'S1-' || a.vec_id AS s1_id, 'S2-' || b.vec_id AS cand_id, list_dot_product(a.u, b.u) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) - 1 AS INT) AS rank FROM sc), ann AS (SELECT s1_id, cand_id, score, rank, 'name' AS channel FROM top WHERE rank < {K})"""
_TRUTH = "truth AS (SELECT 'S1-' || a.vec_id AS s1_id, 'S2-' || b.vec_id AS cand_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id)"
_LEX = "lex AS (SELECT s1_id, cand_id, CAST(1 AS TINYINT) AS pass_id, 0.5e0 AS block_score FROM truth WHERE hash_md5(s1_id, cand_id) < 300)".replace("hash_md5(s1_id, cand_id)", "(('0x' || substring(md5(s1_id || '|' || cand_id), 1, 8))::BIGINT % 1000)")


def _others(top):
    """The first K that aren't the query itself; ``top`` holds one more."""
    rank = F.row_number().over(Window.partitionBy("s1_id").orderBy("rank")) - 1
    return top.where(F.substring("s1_id", 4, 20) != F.substring("cand_id", 4, 20)).withColumn("rank", rank).where(F.col("rank") < K)


class _Vectors:
    def __init__(self, spark, sf):
        e = read(spark, sf, "embeddings")
        self.q = e.where("vec_id % 100 = 0").select(F.concat(F.lit("S1-"), F.col("vec_id")).alias("id"), "embedding", "label", "vec_id")
        self.c = e.select(F.concat(F.lit("S2-"), F.col("vec_id")).alias("id"), "embedding", "label", "vec_id")
        self.ann = _others(ann.flat_topk(self.q.select("id", "embedding"), self.c.select("id", "embedding"), K + 1))
        pair = self.q.select(F.col("id").alias("s1_id"), "label", F.col("vec_id").alias("a")).join(self.c.select(F.col("id").alias("cand_id"), "label", F.col("vec_id").alias("b")), "label")
        self.truth = pair.where("a <> b").select("s1_id", "cand_id")
        from erlink.operators.pairs import md5_bucket

        self.lex = self.truth.where(md5_bucket(F.concat_ws("|", "s1_id", "cand_id"), 1000) < 300).select("s1_id", "cand_id", F.lit(1).cast("tinyint").alias("pass_id"), F.lit(0.5).alias("block_score"))
        self.addr = self.ann.where("rank < 3").withColumn("channel", F.lit("addr"))


@query(f"WITH {_VECTORS} SELECT vec_id, array_to_string(list_transform(u, lambda x: CAST(floor(1e6 * x + 0.5e0) AS BIGINT)), ',') AS unit FROM v")
def q_l2_norm(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.array_join(F.transform(ann.l2_normalize(F.col("embedding")), lambda x: quantised(x).cast("string")), ",").alias("unit"))


@query(f"WITH {_TOP} SELECT s1_id, cand_id, {_Q.format('score')}, rank, channel FROM ann")
def q_flat_topk(spark, sf):
    return _in_millionths(_Vectors(spark, sf).ann, "score")


@query(f"WITH {_TOP}, {_TRUTH} SELECT t.s1_id, t.cand_id, CAST(floor(1e6 * score + 0.5e0) AS BIGINT) AS cosine FROM truth t JOIN sc USING (s1_id, cand_id)")
def q_pair_cosine(spark, sf):
    v = _Vectors(spark, sf)
    return _in_millionths(ann.pair_cosine(v.truth, v.q.select("id", "embedding").unionByName(v.c.select("id", "embedding"))), "cosine")


@query(f"""WITH {_TOP}, {_TRUTH}, {_LEX}, u AS (SELECT s1_id, cand_id, 11 AS pass_id, score AS block_score FROM ann UNION ALL SELECT s1_id, cand_id, 12, score FROM ann WHERE rank < 3 UNION ALL SELECT s1_id, cand_id, pass_id, block_score FROM lex)
SELECT s1_id, cand_id, CAST(pass_id AS INT) AS pass_id, {_Q.format('block_score')}, starts_with(cand_id, 'S2-') AS is_s2 FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, cand_id ORDER BY pass_id, block_score DESC) AS rn FROM u) WHERE rn = 1""")
def q_union_lexical(spark, sf):
    v = _Vectors(spark, sf)
    return _in_millionths(ann.union_with_lexical(v.ann.unionByName(v.addr), v.lex), "block_score")


@query(f"""WITH {_TOP}, {_TRUTH}, {_LEX}, m AS (SELECT t.*, l.s1_id IS NOT NULL AS lex, a.s1_id IS NOT NULL AS n, b.s1_id IS NOT NULL AS d FROM truth t LEFT JOIN lex l USING (s1_id, cand_id) LEFT JOIN ann a USING (s1_id, cand_id) LEFT JOIN (SELECT * FROM ann WHERE rank < 3) b USING (s1_id, cand_id))
SELECT count(*) AS truth, count(CASE WHEN lex THEN 1 END) AS lexical_found, count(CASE WHEN NOT lex THEN 1 END) AS lexical_missed, count(CASE WHEN NOT lex AND n THEN 1 END) AS name, count(CASE WHEN NOT lex AND d THEN 1 END) AS addr,
count(CASE WHEN NOT lex AND (n OR d) THEN 1 END) AS "any", count(CASE WHEN NOT lex AND n AND d THEN 1 END) AS multiple, count(CASE WHEN NOT lex AND NOT n AND NOT d THEN 1 END) AS "none" FROM m""")
def q_channel_attr(spark, sf):
    v = _Vectors(spark, sf)
    return ann.channel_attribution(v.truth, v.lex, {"name": v.ann, "addr": v.addr})


@query(f"WITH {_TOP}, {_TRUTH} SELECT s1_id, cand_id, min(rank) AS min_rank FROM truth LEFT JOIN ann USING (s1_id, cand_id) GROUP BY 1, 2")
def q_min_rank(spark, sf):
    v = _Vectors(spark, sf)
    return ann.min_rank(v.truth, v.ann)


@query(f"""WITH {_TOP}, {_TRUTH}, {_LEX}, r AS (SELECT t.s1_id, t.cand_id, min(rank) AS r, count(l.cand_id) AS l FROM truth t LEFT JOIN ann USING (s1_id, cand_id) LEFT JOIN lex l USING (s1_id, cand_id) GROUP BY 1, 2)
SELECT k, count(CASE WHEN r < k OR l > 0 THEN 1 END) AS recovered, count(CASE WHEN r < k OR l > 0 THEN 1 END) / count(*) AS pair_recall FROM r CROSS JOIN (SELECT unnest([1, 2, 3, 5]) AS k) GROUP BY k""")
def q_recall_curve(spark, sf):
    v = _Vectors(spark, sf)
    return ann.recall_curve(ann.min_rank(v.truth, v.ann), [1, 2, 3, 5], v.lex)


_CH = "ch AS (SELECT s1_id, cand_id, min(p) AS ann_pass, min(rank) AS ret_rank, max(score) AS ret_score, count(DISTINCT p) AS ret_channel_count FROM (SELECT *, 11 AS p FROM ann UNION ALL SELECT *, 12 FROM ann WHERE rank < 3) GROUP BY 1, 2)"


@query(f"WITH {_TOP}, {_CH} SELECT s1_id, cand_id, ann_pass, ret_rank, {_Q.format('ret_score')}, ret_channel_count FROM ch")
def q_channel_pairs(spark, sf):
    v = _Vectors(spark, sf)
    return _in_millionths(ann.channel_pairs(v.ann.unionByName(v.addr)), "ret_score")


@query(f"""WITH {_TOP}, {_TRUTH}, {_LEX}, {_CH}, h AS (SELECT s1_id, cand_id, coalesce(CAST(pass_id AS INT), ann_pass) AS pass_id, coalesce(block_score, ret_score) AS block_score, coalesce(ret_rank, -1) AS ret_rank, coalesce(ret_score, 0e0) AS ret_score, coalesce(ret_channel_count, 0) AS ret_channel_count,
CAST(CASE WHEN pass_id IS NULL THEN 0 ELSE 1 END AS INT) AS has_lex FROM lex FULL JOIN ch USING (s1_id, cand_id)) SELECT * EXCLUDE (rn) REPLACE ({_Q.format('block_score').rsplit(' AS ', 1)[0]} AS block_score, {_Q.format('ret_score').rsplit(' AS ', 1)[0]} AS ret_score) FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY has_lex DESC, ret_score DESC, pass_id, cand_id) AS rn FROM h) WHERE rn <= 4""")
def q_hybrid(spark, sf):
    v = _Vectors(spark, sf)
    return _in_millionths(ann.hybrid(v.lex, v.ann.unionByName(v.addr), 4), "block_score", "ret_score")


@query(f"WITH {_TOP} SELECT s1_id, cand_id, {_Q.format('score')}, rank, channel FROM ann")
def q_ivf_topk(spark, sf):
    """All 16 lists are probed, so that the result is the exact one; tests measure recall at 8."""
    v = _Vectors(spark, sf)
    return _in_millionths(_others(ann.ivf_topk(v.q.select("id", "embedding"), v.c.select("id", "embedding"), K + 1, 16, 16)), "score")


_MILLIONTHS = "array_to_string(list_transform({}, lambda x: CAST(floor(1e6 * x + 0.5e0) AS BIGINT)), ',')"


def _listed(df, name):
    return df.withColumn(name, F.array_join(F.transform(name, lambda x: quantised(x).cast("string")), ","))


@query(f"""WITH g AS (SELECT p_partkey, ('0x' || substring(md5(g), 1, 8))::BIGINT % 64 AS b FROM (SELECT p_partkey, unnest({_GRAMS}) AS g FROM (SELECT p_partkey, lower(p_name) AS t FROM part))),
n AS (SELECT p_partkey AS id, b, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY 1, 2),
f AS (SELECT i.id, list(coalesce(n.n, 0e0) ORDER BY k) AS v FROM (SELECT DISTINCT id FROM n) i CROSS JOIN (SELECT unnest(range(64)) AS k) LEFT JOIN n ON n.id = i.id AND n.b = k GROUP BY i.id)
SELECT id, {_MILLIONTHS.format("list_transform(v, lambda y: y / sqrt(list_dot_product(v, v)))")} AS embedding FROM f""")
def q_hashed_grams(spark, sf):
    return _listed(ann.hashed_grams(read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), 64), "embedding")


_MATRIX = ", ".join("[" + ", ".join(f"{x:.17e}" for x in row) + "]" for row in ann.projection_matrix(64, 16, 42).T.tolist())


@query(f"SELECT vec_id AS id, {_MILLIONTHS.format(f'list_transform([{_MATRIX}], lambda m: list_dot_product(m, CAST(embedding AS DOUBLE[])))')} AS embedding FROM embeddings")
def q_random_projection(spark, sf):
    return _listed(ann.random_projection(read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 64, 16), "embedding")


_SCORE = " + ".join(f"greatest(0e0, least(1e0, coalesce(CAST({f} AS DOUBLE), 0e0))) * {w}" for f, w in LINEAR.items())


@query(f"""WITH {BLOCKED}, {NATIVE}, sc AS (SELECT s1_id, cand_id, ({_SCORE}) / {float(sum(LINEAR.values()))}e0 AS prob FROM native),
m AS (SELECT s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rn FROM sc WHERE prob >= 0.3e0) WHERE rn = 1)
SELECT s1.entity_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS matched_entity_ids FROM s1 LEFT JOIN m ON m.s1_id = s1.entity_id GROUP BY 1""")
def q_linkage(spark, sf):
    p = Hosts(spark, sf)
    return link(p.s1, p.cands, Config(threshold=0.3))["lists"]


_HELD = f"""{BLOCKED}, {NATIVE}, h AS (SELECT DISTINCT s1_id FROM pairs WHERE (('0x' || substring(md5(s1_id), 1, 8))::BIGINT % 1000) < 400),
scored AS (SELECT s1_id, cand_id, CAST(floor(1000e0 * (({_SCORE}) / {float(sum(LINEAR.values()))}e0)) AS BIGINT) AS prob, CAST(CASE WHEN (s1_id, cand_id) IN (SELECT (s1_id, cand_id) FROM truth) THEN 1 ELSE 0 END AS INT) AS label FROM native SEMI JOIN h USING (s1_id)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rn FROM scored) WHERE rn = 1)"""
_TRUE = "SELECT h.s1_id, count(t.cand_id) AS ntrue FROM h LEFT JOIN truth t USING (s1_id) GROUP BY 1"


def _heldout(spark, sf):
    """Per-mille linear scores of all candidates of the two fifths of left records that are held out."""
    p = Hosts(spark, sf)
    cand = blocking.generate_candidates(p.s1, p.cands)
    kept = linkage.heldout_candidates(cand, 0.4)
    rows = features.native_features(features.enrich(kept, p.s1, p.cands)).withColumn("prob", F.floor(1000.0 * linear_score()).cast("long"))
    return rows.select("s1_id", "cand_id", "prob"), cand, p


@query(f"""WITH {_HELD}, a AS ({plain_sweep('scored', GRID, ntrue=_TRUE)}), b AS ({plain_sweep('one', GRID, ntrue=_TRUE)})
SELECT * FROM (SELECT 'threshold' AS variant, threshold, macro_f05 FROM a ORDER BY macro_f05 DESC, threshold LIMIT 1) UNION ALL SELECT * FROM (SELECT 'one_to_one', threshold, macro_f05 FROM b ORDER BY macro_f05 DESC, threshold LIMIT 1)""")
def q_validate_full(spark, sf):
    scored, cand, p = _heldout(spark, sf)
    return linkage.heldout_report(scored, cand, p.truth, GRID, 0.4)


@query(f"WITH {_HELD}, a AS ({plain_sweep('scored', GRID)}) SELECT threshold FROM a ORDER BY macro_f05 DESC, threshold LIMIT 1")
def q_calibrate_heldout(spark, sf):
    scored, _, p = _heldout(spark, sf)
    rows = pairs.label_pairs(scored, p.truth).join(p.s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    return spark.createDataFrame([(linkage.tuned(rows, GRID, list(range(300, 1000, 50))).threshold,)], "threshold int")
