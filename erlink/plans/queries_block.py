"""Queries over blocking, pairs and features."""

from pyspark.sql import functions as F

from erlink.operators import blocking, features, metrics, pairs
from erlink.plans.registry import query
from erlink.plans.roles import BLOCKED, CAPS, CUSTOMERS, HOSTS, Customers, Hosts, keys_sql


class _Blocked(Hosts):
    def __init__(self, spark, sf):
        super().__init__(spark, sf)
        self.idf = blocking.token_idf(self.s1, self.cands)
        self.s1_keys, self.cand_keys = (blocking.block_keys(r, self.idf) for r in (self.s1, self.cands))

    @property
    def pairs(self):
        return blocking.candidates(self.s1_keys, self.cand_keys)


@query(f"WITH {HOSTS} SELECT token, df, CAST(floor(1e6 * idf + 0.5e0) AS BIGINT) AS idf FROM idf")
def q_token_idf(spark, sf):
    return _Blocked(spark, sf).idf.withColumn("idf", metrics.quantised(F.col("idf")))


@query(f"WITH {HOSTS},{keys_sql('cands')} SELECT entity_id, pass_id, key, CAST(block_score AS DOUBLE) AS block_score FROM cands_keys")
def q_block_keys(spark, sf):
    return _Blocked(spark, sf).cand_keys.withColumn("block_score", F.col("block_score").cast("double"))


@query(f"WITH {HOSTS},{keys_sql('cands')} SELECT pass_id, key, count(*) AS n FROM cands_keys GROUP BY pass_id, key HAVING count(*) <= {CAPS}")
def q_block_caps(spark, sf):
    return blocking.valid_keys(_Blocked(spark, sf).cand_keys)


@query(f"WITH {BLOCKED} SELECT s1_id, cand_id, pass_id, CAST(block_score AS DOUBLE) AS block_score FROM joined")
def q_block_join(spark, sf):
    b = _Blocked(spark, sf)
    return blocking.block_join(b.s1_keys, b.cand_keys).withColumn("block_score", F.col("block_score").cast("double"))


@query(f"WITH {BLOCKED} SELECT s1_id, cand_id, pass_id, CAST(block_score AS DOUBLE) AS block_score FROM dedup")
def q_dedup_pairs(spark, sf):
    b = _Blocked(spark, sf)
    return blocking.dedup_pairs(blocking.block_join(b.s1_keys, b.cand_keys)).withColumn("block_score", F.col("block_score").cast("double"))


@query(f"WITH {BLOCKED} SELECT s1_id, cand_id, pass_id, CAST(block_score AS DOUBLE) AS block_score, is_s2 FROM pairs")
def q_candidates(spark, sf):
    return _Blocked(spark, sf).pairs.withColumn("block_score", F.col("block_score").cast("double"))


@query(f"WITH {HOSTS} SELECT entity_id, state_key || '|' || CASE WHEN length(coalesce(toks[1], '')) >= 4 THEN toks[1] ELSE substring(coalesce(toks[1], ''), 1, 3) END AS key FROM cands")
def q_bench_key(spark, sf):
    c = Hosts(spark, sf).cands
    return c.select("entity_id", blocking.bench_key(F.col("state_key"), F.col("name_norm")).alias("key"))


@query(f"""WITH {BLOCKED}, f AS (SELECT t.*, p.s1_id IS NOT NULL AS found FROM truth t LEFT JOIN (SELECT DISTINCT s1_id, cand_id FROM pairs) p USING (s1_id, cand_id)),
per AS (SELECT s1_id, count(*) AS n FROM pairs GROUP BY s1_id), e AS (SELECT sum(n) AS n_pairs, count(*) AS n_with, sum(CASE WHEN s1_id NOT IN (SELECT s1_id FROM truth) THEN n END) AS sp, count(CASE WHEN s1_id NOT IN (SELECT s1_id FROM truth) THEN 1 END) AS sn FROM per)
SELECT (SELECT count(*) FROM f) AS n_truth, (SELECT count(*) FROM f WHERE found) AS n_found, (SELECT count(*) FROM f WHERE found) / (SELECT count(*) FROM f) AS recall, CAST(coalesce(n_pairs, 0) AS BIGINT) AS n_pairs,
CAST(n_pairs AS DOUBLE) / nullif(n_with, 0) AS candidates_per_s1, CAST(sp AS DOUBLE) / nullif(sn, 0) AS candidates_per_singleton, CAST(n_pairs AS DOUBLE) / (SELECT count(*) FROM cands) AS reduction_ratio FROM e""")
def q_audit(spark, sf):
    b = _Blocked(spark, sf)
    return metrics.blocking_audit(b.truth, b.pairs, b.s1.select(F.col("entity_id").alias("s1_id")), b.cands)


@query(f"""WITH {BLOCKED}, n AS (SELECT count(*) AS n FROM truth), f AS (SELECT pass_id, count(*) AS f FROM truth JOIN (SELECT DISTINCT s1_id, cand_id, pass_id FROM pairs) USING (s1_id, cand_id) GROUP BY pass_id)
SELECT pass_id, coalesce(f, 0) AS n_found, coalesce(f, 0) / n AS recall FROM (SELECT DISTINCT pass_id FROM pairs) LEFT JOIN f USING (pass_id), n""")
def q_pass_recall(spark, sf):
    b = _Blocked(spark, sf)
    return metrics.pass_recall(b.truth, b.pairs)


@query(f"""WITH {CUSTOMERS} SELECT country, count(*) AS n_truth, count(c.cand_id) AS n_found, count(c.cand_id) / count(*) AS recall
FROM truth t LEFT JOIN (SELECT DISTINCT s1_id, cand_id FROM candidates) c USING (s1_id, cand_id) JOIN countries ON entity_id = t.s1_id GROUP BY country""")
def q_audit_by_country(spark, sf):
    c = Customers(spark, sf)
    return metrics.recall_by(c.truth, c.candidates, c.countries)


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id FROM (SELECT source1_entity_id AS s1_id, unnest(string_split(matched_entity_ids, ',')) AS cand_id FROM truth_lists) WHERE cand_id <> ''")
def q_truth_explode(spark, sf):
    return pairs.explode_truth(Customers(spark, sf).truth_lists)


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id, CAST(CASE WHEN (s1_id, cand_id) IN (SELECT (s1_id, cand_id) FROM truth) THEN 1 ELSE 0 END AS INT) AS label FROM scored")
def q_label_pairs(spark, sf):
    c = Customers(spark, sf)
    return pairs.label_pairs(c.pairs, c.truth)


_MD5 = "(('0x' || substring(md5({}), 1, 8))::BIGINT % {})"


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id, CAST(0 AS INT) AS label FROM scored ANTI JOIN truth USING (s1_id, cand_id) WHERE {_MD5.format("s1_id || '|' || cand_id", 1000000)} < 200000")
def q_neg_sample(spark, sf):
    c = Customers(spark, sf)
    return pairs.sample_negatives(pairs.negatives(c.pairs, c.truth), 20.0)


@query(f"""WITH {CUSTOMERS}, n AS (SELECT CAST(floor(least(100e0, greatest(1e-4, 100e0 * 4e0 * (SELECT count(*) FROM scored SEMI JOIN truth USING (s1_id, cand_id)) / (SELECT count(*) FROM scored))) * 1e4) AS BIGINT) AS t)
SELECT s1_id, cand_id, CAST(1 AS INT) AS label FROM scored SEMI JOIN truth USING (s1_id, cand_id)
UNION ALL SELECT s1_id, cand_id, CAST(0 AS INT) FROM scored ANTI JOIN truth USING (s1_id, cand_id) WHERE {_MD5.format("s1_id || '|' || cand_id", 1000000)} < (SELECT t FROM n)""")
def q_training_pairs(spark, sf):
    c = Customers(spark, sf)
    return pairs.training_pairs(c.pairs, c.truth)


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id, {_MD5.format('s1_id', 1000)} < 200 AS is_val FROM scored")
def q_group_split(spark, sf):
    return pairs.grouped_split(Customers(spark, sf).pairs)


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id FROM scored WHERE {_MD5.format('s1_id', 1000)} < 200")
def q_heldout_pairs(spark, sf):
    c = Customers(spark, sf)
    return pairs.restrict(c.pairs, pairs.heldout_ids(c.pairs))


@query(f"WITH {CUSTOMERS} SELECT s1_id FROM (SELECT DISTINCT s1_id FROM scored WHERE {_MD5.format('s1_id', 1000)} < 200) JOIN countries ON entity_id = s1_id WHERE country = 'nation_3'")
def q_country_ids(spark, sf):
    c = Customers(spark, sf)
    return pairs.ids_of_country(pairs.heldout_ids(c.pairs), c.countries, "nation_3")


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id, CAST(0 AS INT) AS label FROM scored ANTI JOIN truth USING (s1_id, cand_id) ORDER BY md5('42|' || s1_id || '|' || cand_id), s1_id, cand_id LIMIT 500")
def q_random_negatives(spark, sf):
    c = Customers(spark, sf)
    return pairs.random_negatives(pairs.negatives(c.pairs, c.truth), 500)


_BENCH = "state_key || '|' || CASE WHEN length(coalesce(toks[1], '')) >= 4 THEN toks[1] ELSE substring(coalesce(toks[1], ''), 1, 3) END"


@query(f"""WITH {BLOCKED}, p AS (SELECT s1_id, cand_id, md5(s1_id || '|' || cand_id) AS m FROM (SELECT entity_id AS s1_id, {_BENCH} AS key FROM s1) JOIN (SELECT entity_id AS cand_id, {_BENCH} AS key FROM cands) USING (key) ANTI JOIN truth USING (s1_id, cand_id)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY m, s1_id) AS rn FROM p) WHERE rn = 1)
SELECT s1_id, cand_id FROM (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY m, cand_id) AS rn FROM once) WHERE rn <= 5""")
def q_hard_negatives(spark, sf):
    b = Hosts(spark, sf)
    key = lambda r, n: r.select(F.col("entity_id").alias(n), blocking.bench_key(F.col("state_key"), F.col("name_norm")).alias("key"))
    return pairs.hard_negatives(key(b.s1, "s1_id"), key(b.cands, "cand_id"), b.truth)


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id, count(*) OVER (PARTITION BY s1_id) AS s1_degree, count(*) OVER (PARTITION BY cand_id) AS cand_degree FROM candidates")
def q_degrees(spark, sf):
    return features.degrees(Customers(spark, sf).candidates.select("s1_id", "cand_id"))


_JAC = "coalesce(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0e0)"
_CON = "coalesce(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / nullif(least(len(list_distinct({a})), len(list_distinct({b}))), 0), 0e0)"
_NAME, _STREET = {"a": "l.name_tokens", "b": "r.name_tokens"}, {"a": "l.street_tokens", "b": "r.street_tokens"}
_EQ = "CAST(CASE WHEN l.{c} = r.{c} AND l.{c} <> '' THEN 1 ELSE 0 END AS INT)"


NATIVE = f"""d AS (SELECT *, count(*) OVER (PARTITION BY s1_id) AS s1_degree, count(*) OVER (PARTITION BY cand_id) AS cand_degree FROM pairs),
native AS (SELECT s1_id, cand_id, CAST(pass_id AS INT) AS pass_id, CAST(block_score AS DOUBLE) AS block_score, CAST(abs(length(l.name_norm) - length(r.name_norm)) AS INT) AS addr_len_diff, CAST(CASE WHEN l.name_norm = r.name_norm THEN 1 ELSE 0 END AS INT) AS name_exact, {_JAC.format(**_NAME)} AS name_jaccard, {_CON.format(**_NAME)} AS name_containment,
CAST(CASE WHEN list_sort(list_distinct(l.name_tokens)) = list_sort(list_distinct(r.name_tokens)) AND len(l.name_tokens) > 0 THEN 1 ELSE 0 END AS INT) AS name_sorted_eq,
CAST(abs(length(l.name_norm) - length(r.name_norm)) AS INT) AS name_len_diff, CAST(abs(len(l.toks) - len(r.toks)) AS INT) AS token_count_diff,
CASE WHEN l.name_norm = '' OR r.name_norm = '' THEN -1e0 ELSE {_JAC.format(**_STREET)} END AS addr_jaccard, CASE WHEN l.name_norm = '' OR r.name_norm = '' THEN -1e0 ELSE {_CON.format(**_STREET)} END AS addr_containment,
{_EQ.format(c='house_no')} AS house_match, {_JAC.format(**_STREET)} AS street_jaccard, {_EQ.format(c='postal')} AS postal_exact,
CAST(CASE WHEN length(l.postal) >= 3 AND substring(l.postal, 1, 3) = substring(r.postal, 1, 3) THEN 1 ELSE 0 END AS INT) AS postal_prefix3, {_EQ.format(c='state_key')} AS state_match,
CAST(l.landmark_flag AS INT) AS landmark, CAST(l.name_norm = '' AS INT) AS addr_missing, {_EQ.format(c='state_key')} AS same_country, CAST(is_s2 AS INT) AS is_s2, s1_degree, cand_degree
FROM d JOIN s1 l ON l.entity_id = s1_id JOIN cands r ON r.entity_id = cand_id)"""


@query(f"WITH {BLOCKED}, {NATIVE} SELECT * FROM native")
def q_features_native(spark, sf):
    b = _Blocked(spark, sf)
    out = features.native_features(features.enrich(b.pairs, b.s1, b.cands)).withColumns({"pass_id": F.col("pass_id").cast("int"), "block_score": F.col("block_score").cast("double")})
    names = "pass_id block_score addr_len_diff name_exact name_jaccard name_containment name_sorted_eq name_len_diff token_count_diff addr_jaccard addr_containment house_match street_jaccard postal_exact postal_prefix3 state_match landmark addr_missing same_country is_s2 s1_degree cand_degree"
    return out.select("s1_id", "cand_id", *names.split())


_GRAMS = "CASE WHEN length(t) >= 3 THEN list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)) ELSE [] END"
_TEXTS = r"texts AS (SELECT regexp_replace(lower(p_name), '\s\s+', ' ', 'g') AS t, p_name FROM part)"
_IDF = f"gi AS (SELECT g AS gram, count(*) AS df, ln((1e0 + (SELECT count(*) FROM texts)) / (1e0 + count(*))) + 1e0 AS idf FROM (SELECT unnest(list_distinct({_GRAMS})) AS g FROM texts) GROUP BY g HAVING count(*) >= 3)"


def _part_texts(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.col("p_name").alias("text"))


@query(f"WITH {_TEXTS}, {_IDF} SELECT gram, df, CAST(floor(1e6 * idf + 0.5e0) AS BIGINT) AS idf FROM gi")
def q_char_idf(spark, sf):
    return features.fit_char_idf(_part_texts(spark, sf)).withColumn("idf", metrics.quantised(F.col("idf")))


@query(f"WITH {_TEXTS}, {_IDF} SELECT count(*) AS n_grams, CAST(sum(('0x' || substring(sha1(gram), 1, 8))::BIGINT) AS BIGINT) AS digest FROM gi")
def q_char_vocabulary(spark, sf):
    return features.vocabulary_digest(features.fit_char_idf(_part_texts(spark, sf)))


@query(f"""WITH {_TEXTS}, {_IDF}, tf AS (SELECT p_name, g AS gram, count(*) AS n FROM (SELECT p_name, unnest({_GRAMS}) AS g FROM (SELECT DISTINCT p_name, t FROM texts)) GROUP BY 1, 2),
w AS (SELECT p_name, gram, (1e0 + ln(n)) * idf AS w FROM tf JOIN gi USING (gram)), nrm AS (SELECT p_name, sqrt(sum(w * w)) AS nrm FROM w GROUP BY 1),
v AS (SELECT p_name, gram, w / nrm AS u FROM w JOIN nrm USING (p_name)), pr AS (SELECT a.p_partkey AS s1_id, b.p_partkey AS cand_id, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
c AS (SELECT x, y, sum(p.u * q.u) AS c FROM (SELECT DISTINCT x, y FROM pr) JOIN v p ON p.p_name = x JOIN v q ON q.p_name = y AND q.gram = p.gram GROUP BY x, y)
SELECT s1_id, cand_id, CAST(floor(1e6 * coalesce(c, 0e0) + 0.5e0) AS BIGINT) AS cosine FROM pr LEFT JOIN c USING (x, y)""")
def q_char3_cos(spark, sf):
    t = _part_texts(spark, sf)
    nxt = t.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("text").alias("y"))
    pr = t.join(nxt, "p_partkey").select(F.col("p_partkey").alias("s1_id"), (F.col("p_partkey") + 1).alias("cand_id"), F.col("text").alias("x"), "y")
    out = features.char3_cosine(pr, features.char_vectors(t, features.fit_char_idf(t)), "x", "y", "c")
    return out.select("s1_id", "cand_id", F.floor(1e6 * F.col("c") + 0.5).cast("long").alias("cosine"))


@query(f"""WITH {CUSTOMERS} SELECT s1_id, cand_id, coalesce(name_e5_cos, -1e0) AS name_e5_cos, coalesce(addr_e5_cos, -1e0) AS addr_e5_cos FROM scored
LEFT JOIN (SELECT s1_id, cand_id, prob / 1000e0 AS name_e5_cos, (prob // 2) / 1000e0 AS addr_e5_cos FROM scored WHERE prob % 2 = 0) USING (s1_id, cand_id)""")
def q_merge_cosine(spark, sf):
    c = Customers(spark, sf)
    cos = c.scored.where("prob % 2 = 0").select("s1_id", "cand_id", (F.col("prob") / 1000.0).alias("name_e5_cos"), (F.expr("prob div 2") / 1000.0).alias("addr_e5_cos"))
    names = ("name_e5_cos", "addr_e5_cos")
    return features.merge_cosine(c.pairs.withColumn("name_e5_cos", F.lit(0.0)), features.import_cosine(cos, names), names)


@query(f"""WITH {HOSTS}, r AS (SELECT (CASE WHEN page_id % 2 = 0 THEN 'S2-' ELSE 'S3-' END) || page_id AS entity_id, url AS n, lang AS a FROM pg)
SELECT entity_id, coalesce(n, name_norm) AS name_raw, coalesce(a, name_norm) AS addr_raw, name_norm, name_norm AS name_roman, name_norm AS addr_norm FROM cands LEFT JOIN r USING (entity_id)""")
def q_export_entities(spark, sf):
    b = Hosts(spark, sf)
    raw = b.pages.select(F.concat(b.prefix, F.col("page_id")).alias("entity_id"), F.col("url").alias("business_name"), F.col("lang").alias("business_address"))
    return features.export_entities(raw, b.cands.withColumn("name_roman", F.col("name_norm")))


@query()
def q_all_features(spark, sf):
    b = _Blocked(spark, sf)
    add = lambda r: r.withColumn("name_fold", F.col("name_norm")).withColumn("name_roman", F.col("name_norm"))
    s1, cands = add(b.s1), add(b.cands)
    idf = features.fit_char_idf(cands.select(F.col("name_norm").alias("text")))
    return features.all_features(b.pairs, s1, cands, idf)
