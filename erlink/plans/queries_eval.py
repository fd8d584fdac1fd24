"""Queries over decisions, metrics, profiles and list checks (roles of ``Customers``)."""

from pyspark.sql import functions as F

from erlink.operators import decide, metrics, quality
from erlink.plans.registry import query
from erlink.plans.roles import CUSTOMERS, Customers, read

GRID = [50 + 25 * i for i in range(37)]
WIDE = [200 + 25 * i for i in range(31)]
BY_COUNTRY = {"nation_0": 925, "nation_3": 800, "nation_7": 990}
_CT = "CASE country " + " ".join(f"WHEN '{c}' THEN {t}" for c, t in BY_COUNTRY.items()) + " ELSE 950 END"
_ONE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY prob DESC, s1_id) AS rn FROM {}) WHERE rn = 1"


def f_sql(ntrue: str = "ntrue", npred: str = "npred", tp: str = "tp") -> str:
    p, r = f"(CAST({tp} AS DOUBLE) / {npred})", f"(CAST({tp} AS DOUBLE) / {ntrue})"
    return f"CASE WHEN {ntrue} = 0 THEN CASE WHEN {npred} = 0 THEN 1e0 ELSE 0e0 END WHEN {npred} = 0 OR {tp} = 0 THEN 0e0 ELSE 1.25e0 * {p} * {r} / (0.25e0 * {p} + {r}) END"


_MEAN = "CAST(sum(CAST(floor(score * 1e6 + 0.5e0) AS BIGINT)) AS DOUBLE) / (count(*) * 1e6)"


def counts_sql(pred: str, universe: str = "s1") -> str:
    return f"""SELECT u.s1_id, coalesce(a.n, 0) AS ntrue, coalesce(b.n, 0) AS npred, coalesce(c.n, 0) AS tp FROM (SELECT DISTINCT s1_id FROM {universe}) u
LEFT JOIN (SELECT s1_id, count(*) AS n FROM (SELECT DISTINCT s1_id, cand_id FROM truth) GROUP BY 1) a USING (s1_id)
LEFT JOIN (SELECT s1_id, count(*) AS n FROM (SELECT DISTINCT s1_id, cand_id FROM {pred}) GROUP BY 1) b USING (s1_id)
LEFT JOIN (SELECT s1_id, count(*) AS n FROM (SELECT DISTINCT s1_id, cand_id FROM {pred}) SEMI JOIN truth USING (s1_id, cand_id) GROUP BY 1) c USING (s1_id)"""


# rows at or above each threshold, joined by entity: the plain form of the sweep
def plain_sweep(rows: str, grid: list[int], by: str = "", ntrue: str | None = None) -> str:
    e = f"SELECT {by} s1_id, sum(label) AS ntrue FROM {rows} GROUP BY {by} s1_id" if ntrue is None else ntrue
    using = "s1_id" if not by else by + " s1_id"
    return f"""SELECT {by} threshold, count(*) AS n_entities, {_MEAN} AS macro_f05 FROM (SELECT {by} threshold, {f_sql()} AS score FROM (
SELECT {by} s1_id, threshold, any_value(ntrue) AS ntrue, count(CASE WHEN prob >= threshold THEN 1 END) AS npred, coalesce(sum(CASE WHEN prob >= threshold THEN label END), 0) AS tp
FROM ({e}) LEFT JOIN (SELECT {by} s1_id, prob, label FROM {rows}) USING ({using}) CROSS JOIN (SELECT unnest({grid}) AS threshold) GROUP BY {by} s1_id, threshold)) GROUP BY {by} threshold"""


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id, prob FROM scored WHERE prob >= 900")
def q_threshold(spark, sf):
    return decide.apply_threshold(Customers(spark, sf).scored, 900).select("s1_id", "cand_id", "prob")


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id, prob FROM scored LEFT JOIN countries ON entity_id = s1_id WHERE prob >= {_CT}")
def q_country_threshold(spark, sf):
    c = Customers(spark, sf)
    return decide.apply_country_thresholds(c.scored, c.countries, 950, BY_COUNTRY).select("s1_id", "cand_id", "prob")


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id, prob FROM (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS m FROM scored) WHERE m >= 970")
def q_singleton(spark, sf):
    return decide.singleton_rule(Customers(spark, sf).scored, 970).select("s1_id", "cand_id", "prob")


@query(f"WITH {CUSTOMERS} SELECT s1_id, cand_id, prob FROM ({_ONE.format('scored')})")
def q_one_to_one(spark, sf):
    return decide.one_to_one(Customers(spark, sf).scored).select("s1_id", "cand_id", "prob")


_CAL = decide.Calibration(950, BY_COUNTRY, 960, True)
_MATCHES = f"""matches AS (SELECT s1_id, cand_id FROM ({_ONE.format(f'(SELECT s1_id, cand_id, prob FROM (SELECT *, max(prob) OVER (PARTITION BY s1_id) AS m FROM scored WHERE prob >= 800) LEFT JOIN countries ON entity_id = s1_id WHERE m >= 960 AND prob >= {_CT})')}))"""


def _matches(c):
    return decide.apply_calibration(c.scored, c.countries, _CAL)


@query(f"WITH {CUSTOMERS}, {_MATCHES} SELECT s1_id, cand_id FROM matches")
def q_calibrated_matches(spark, sf):
    return _matches(Customers(spark, sf))


@query(f"WITH {CUSTOMERS}, {_MATCHES} SELECT s1.s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS matched_entity_ids FROM s1 LEFT JOIN matches USING (s1_id) GROUP BY 1")
def q_match_lists(spark, sf):
    c = Customers(spark, sf)
    return decide.match_lists(_matches(c), c.s1)


@query(f"WITH {CUSTOMERS} SELECT s1.s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS candidate_entity_ids FROM s1 LEFT JOIN candidates USING (s1_id) GROUP BY 1")
def q_candidate_lists(spark, sf):
    c = Customers(spark, sf)
    return decide.candidate_lists(c.candidates, c.s1)


@query(f"WITH {CUSTOMERS}, {_MATCHES} SELECT n AS n_matches, count(*) AS n_records FROM (SELECT s1.s1_id, count(m.cand_id) AS n FROM s1 LEFT JOIN matches m USING (s1_id) GROUP BY 1) GROUP BY n")
def q_match_dist(spark, sf):
    c = Customers(spark, sf)
    return decide.match_distribution(_matches(c), c.s1)


@query(f"WITH {CUSTOMERS}, {_MATCHES} SELECT (SELECT count(*) FROM matches) AS match_rows, (SELECT count(*) FROM candidates) AS candidate_rows")
def q_list_counts(spark, sf):
    c = Customers(spark, sf)
    return decide.list_row_counts(_matches(c), c.candidates)


@query(f"WITH {CUSTOMERS}, p AS (SELECT * FROM scored WHERE prob >= 900), c AS ({counts_sql('p')}) SELECT s1_id, ntrue, npred, tp, {f_sql()} AS score FROM c")
def q_entity_scores(spark, sf):
    c = Customers(spark, sf)
    return metrics.entity_scores(metrics.entity_counts(c.s1, c.truth, decide.apply_threshold(c.scored, 900)))


@query(f"WITH {CUSTOMERS}, p AS (SELECT * FROM scored WHERE prob >= 900), u AS (SELECT s1_id FROM truth UNION SELECT s1_id FROM p), c AS ({counts_sql('p', 'u')}) SELECT count(*) AS n_entities, {_MEAN} AS macro_f05 FROM (SELECT {f_sql()} AS score FROM c)")
def q_macro_f05(spark, sf):
    c = Customers(spark, sf)
    return metrics.macro_f05(c.truth, decide.apply_threshold(c.scored, 900).select("s1_id", "cand_id"))


@query(f"WITH {CUSTOMERS}, c AS (SELECT s1_id, sum(label) AS ntrue, count(CASE WHEN prob >= 900 THEN 1 END) AS npred, count(CASE WHEN prob >= 900 AND label = 1 THEN 1 END) AS tp FROM scored GROUP BY 1) SELECT count(*) AS n_entities, {_MEAN} AS macro_f05 FROM (SELECT {f_sql()} AS score FROM c)")
def q_row_f05(spark, sf):
    return metrics.row_f05(Customers(spark, sf).scored, 900)


@query(f"WITH {CUSTOMERS} {plain_sweep('scored', GRID)}")
def q_sweep(spark, sf):
    return metrics.sweep(Customers(spark, sf).scored, GRID)


@query(f"WITH {CUSTOMERS}, w AS ({plain_sweep('scored', GRID)}) SELECT threshold, macro_f05 FROM w ORDER BY macro_f05 DESC, threshold LIMIT 1")
def q_best_threshold(spark, sf):
    return metrics.best_threshold(metrics.sweep(Customers(spark, sf).scored, GRID))


@query(f"WITH {CUSTOMERS} SELECT bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_true FROM (SELECT label, least(CAST(floor((prob / 1000e0 - 0.2e0) / 0.025e0 + 1e-9) AS INT), 30) AS bin FROM scored WHERE prob / 1000e0 >= 0.2e0) GROUP BY bin")
def q_score_bins(spark, sf):
    rows = Customers(spark, sf).scored.withColumn("bin", metrics.score_bin(F.col("prob") / 1000.0, 0.2, 0.025, 31)).where("bin is not null")
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("n_true"))


_NTRUE = "SELECT s1.s1_id, count(t.cand_id) AS ntrue FROM s1 LEFT JOIN truth t USING (s1_id) GROUP BY 1"


def _ntrue(c):
    return metrics.entity_counts(c.s1, c.truth, c.truth).select("s1_id", "ntrue")


@query(f"WITH {CUSTOMERS}, one AS ({_ONE.format('scored')}) {plain_sweep('one', WIDE, ntrue=_NTRUE)}")
def q_sweep_one_to_one(spark, sf):
    c = Customers(spark, sf)
    return metrics.sweep(decide.one_to_one(c.scored), WIDE, ntrue=_ntrue(c))


@query(f"""WITH {CUSTOMERS}, one AS ({_ONE.format('scored')}), a AS ({plain_sweep('scored', WIDE, ntrue=_NTRUE)}), b AS ({plain_sweep('one', WIDE, ntrue=_NTRUE)})
SELECT * FROM (SELECT 'threshold' AS variant, threshold, macro_f05 FROM a ORDER BY macro_f05 DESC, threshold LIMIT 1) UNION ALL SELECT * FROM (SELECT 'one_to_one', threshold, macro_f05 FROM b ORDER BY macro_f05 DESC, threshold LIMIT 1)""")
def q_compare_decisions(spark, sf):
    c = Customers(spark, sf)
    return metrics.compare_decisions(c.scored, _ntrue(c), WIDE)


@query(f"""WITH {CUSTOMERS}, r AS (SELECT country, s1_id, cand_id, prob, label FROM scored JOIN countries ON entity_id = s1_id), w AS ({plain_sweep('r', GRID, 'country,')}),
b AS (SELECT country, threshold FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY macro_f05 DESC, threshold) AS rn FROM w) WHERE rn = 1)
SELECT country, CAST(CASE WHEN n < 60 OR lo = hi THEN 950 ELSE threshold END AS INT) AS threshold FROM (SELECT country, count(DISTINCT s1_id) AS n, min(label) AS lo, max(label) AS hi FROM r GROUP BY 1) LEFT JOIN b USING (country)""")
def q_tune_country(spark, sf):
    c = Customers(spark, sf)
    rows = c.scored.join(c.countries, c.scored["s1_id"] == c.countries["entity_id"]).select("country", "s1_id", "cand_id", "prob", "label")
    return metrics.tune_per_country(rows, GRID, 950, least=60)


_TAUS = [300 + 10 * i for i in range(70)]


@query(f"""WITH {CUSTOMERS}, p AS (SELECT s1_id, max(prob) AS best, sum(label) AS ntrue, count(CASE WHEN prob >= 900 THEN 1 END) AS np, count(CASE WHEN prob >= 900 AND label = 1 THEN 1 END) AS t FROM scored GROUP BY 1),
e AS (SELECT tau, ntrue, CASE WHEN best >= tau THEN np ELSE 0 END AS npred, CASE WHEN best >= tau THEN t ELSE 0 END AS tp FROM p CROSS JOIN (SELECT unnest({_TAUS}) AS tau))
SELECT tau, {_MEAN} AS macro_f05 FROM (SELECT tau, {f_sql()} AS score FROM e) GROUP BY tau""")
def q_tune_tau(spark, sf):
    return metrics.tune_singleton_tau(Customers(spark, sf).scored, _TAUS, F.lit(900))


@query(f"WITH {CUSTOMERS}, f AS (SELECT count(*) AS n_truth, count(c.cand_id) AS n_found FROM truth LEFT JOIN (SELECT DISTINCT s1_id, cand_id FROM candidates) c USING (s1_id, cand_id)) SELECT n_truth, n_found, n_found / n_truth AS recall FROM f")
def q_recall_ceiling(spark, sf):
    c = Customers(spark, sf)
    return metrics.recall_ceiling(c.truth, c.candidates)


_ORACLE = """oc AS (SELECT s1.s1_id, coalesce(ntrue, 0) AS ntrue, coalesce(nfound, 0) AS nfound FROM s1 LEFT JOIN (SELECT t.s1_id, count(*) AS ntrue, count(c.cand_id) AS nfound FROM truth t LEFT JOIN (SELECT DISTINCT s1_id, cand_id FROM candidates) c USING (s1_id, cand_id) GROUP BY 1) USING (s1_id)),
os AS (SELECT *, CASE WHEN ntrue = 0 THEN 1e0 WHEN nfound = 0 THEN 0e0 ELSE 1.25e0 * (CAST(nfound AS DOUBLE) / ntrue) / (0.25e0 + CAST(nfound AS DOUBLE) / ntrue) END AS score FROM oc)"""


@query(f"WITH {CUSTOMERS}, {_ORACLE} SELECT s1_id, ntrue, nfound, score FROM os")
def q_oracle(spark, sf):
    c = Customers(spark, sf)
    return metrics.oracle_counts(c.s1, c.truth, c.candidates)


@query(f"""WITH {CUSTOMERS}, {_ORACLE} SELECT count(*) AS n_entities, CAST(sum(ntrue) AS BIGINT) AS n_truth, CAST(sum(nfound) AS BIGINT) AS n_found, CAST(sum(nfound) AS DOUBLE) / CAST(sum(ntrue) AS DOUBLE) AS pair_recall, count(CASE WHEN ntrue > 0 AND nfound = 0 THEN 1 END) AS n_none_found,
CAST(sum(CASE WHEN ntrue > 0 THEN CAST(floor(CAST(nfound AS DOUBLE) / ntrue * 1e6 + 0.5e0) AS BIGINT) END) AS DOUBLE) / (count(CASE WHEN ntrue > 0 THEN 1 END) * 1e6) AS mean_entity_recall, {_MEAN} AS oracle_f05 FROM os""")
def q_diagnostic(spark, sf):
    c = Customers(spark, sf)
    return metrics.oracle_summary(c.s1, c.truth, c.candidates)


@query(f"""WITH {CUSTOMERS}, {_MATCHES}, c AS ({counts_sql('matches')}), s AS (SELECT country, {f_sql()} AS score FROM c LEFT JOIN countries ON entity_id = s1_id)
SELECT country, count(*) AS n_entities, {_MEAN} AS macro_f05 FROM s GROUP BY country UNION ALL SELECT 'all', count(*), {_MEAN} FROM s""")
def q_score_calibration(spark, sf):
    c = Customers(spark, sf)
    return metrics.score_calibration(c.scored, c.truth, c.s1, c.countries, _matches(c))


@query(f"""WITH {CUSTOMERS}, a AS (SELECT *, max(label) OVER (PARTITION BY s1_id) AS m FROM scored), q AS (SELECT count(CASE WHEN prob >= 900 THEN 1 END) AS n_pred, count(CASE WHEN prob >= 900 AND label = 1 THEN 1 END) AS n_right, CAST(sum(label) AS BIGINT) AS n_true, count(CASE WHEN prob >= 900 AND m = 0 THEN 1 END) AS false_merges FROM a)
SELECT *, n_right / n_pred AS precision, n_right / n_true AS recall FROM q""")
def q_pair_quality(spark, sf):
    return metrics.pair_quality(Customers(spark, sf).scored, 900)


def _fractions(c):
    return c.scored.withColumn("prob", F.col("prob") / 1000.0)


@query(f"""WITH {CUSTOMERS}, g AS (SELECT prob, sum(label) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg FROM scored GROUP BY 1), h AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT CAST(sum(pos * (2 * nb + neg)) AS DOUBLE) / (2e0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM h""")
def q_auc(spark, sf):
    return metrics.auc(_fractions(Customers(spark, sf)))


@query(f"""WITH {CUSTOMERS}, g AS (SELECT prob, CAST(sum(label) AS BIGINT) AS pos, count(*) AS n FROM scored GROUP BY 1), h AS (SELECT pos, CAST(sum(pos) OVER (ORDER BY prob DESC) AS BIGINT) AS ap, CAST(sum(n) OVER (ORDER BY prob DESC) AS BIGINT) AS an FROM g)
SELECT CAST(sum(CAST(floor(pos * (CAST(ap AS DOUBLE) / an) * 1e6 + 0.5e0) AS BIGINT)) AS DOUBLE) / (sum(pos) * 1e6) AS average_precision FROM h WHERE pos > 0""")
def q_avg_precision(spark, sf):
    return metrics.average_precision(_fractions(Customers(spark, sf)))


_WEIGHT = f"len(list_filter({metrics.POISSON}, lambda t: t <= ((h * (2 * i + 1) + i * 2654435761) & 4294967295)))"


@query(f"""WITH {CUSTOMERS}, p AS (SELECT * FROM scored WHERE prob >= 900), c AS ({counts_sql('p')}), e AS (SELECT ('0x' || substring(md5(s1_id), 1, 8))::BIGINT AS h, {f_sql()} AS score FROM c),
m AS (SELECT i, CAST(sum(n * CAST(floor(score * 1e6 + 0.5e0) AS BIGINT)) AS DOUBLE) / CAST(sum(n) AS DOUBLE) / 1e6 AS m FROM (SELECT i, score, {_WEIGHT} AS n FROM e CROSS JOIN (SELECT unnest(range(500)) AS i)) GROUP BY i)
SELECT (SELECT {_MEAN} FROM e) AS mean, CAST(floor(1e6 * quantile_cont(m, 0.025) + 0.5e0) AS BIGINT) AS ci_low, CAST(floor(1e6 * quantile_cont(m, 0.975) + 0.5e0) AS BIGINT) AS ci_high FROM m""")
def q_bootstrap_ci(spark, sf):
    c = Customers(spark, sf)
    out = metrics.bootstrap_ci(metrics.entity_scores(metrics.entity_counts(c.s1, c.truth, decide.apply_threshold(c.scored, 900))))
    return out.withColumns({n: metrics.quantised(F.col(n)) for n in ("ci_low", "ci_high")})


# profiles and checks -----------------------------------------------------------------------------------


def _profiled(spark, sf):
    d = read(spark, sf, "documents")
    return d.select(F.concat(F.lit("S2-"), F.col("doc_id") % 900).alias("entity_id"), F.col("text").alias("business_name"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.concat(F.col("doc_id"), F.lit(" main st"))).alias("business_address"), F.col("lang").alias("country"))


_PROFILED = "p AS (SELECT 'S2-' || doc_id % 900 AS entity_id, text AS n, CASE WHEN doc_id % 9 = 0 THEN '' ELSE doc_id || ' main st' END AS a, lang AS country FROM documents)"


@query(f"""WITH {_PROFILED} SELECT count(*) AS n_rows, count(DISTINCT entity_id) AS unique_ids, count(*) - count(DISTINCT entity_id) AS duplicate_ids, count(CASE WHEN trim(n) = '' THEN 1 END) AS empty_name, count(CASE WHEN trim(a) = '' THEN 1 END) AS empty_address,
count(CASE WHEN trim(country) = '' THEN 1 END) AS empty_country, count(CASE WHEN regexp_matches(n, '\\?{{2,}}') OR regexp_matches(a, '\\?{{2,}}') THEN 1 END) AS question_marks, count(CASE WHEN regexp_matches(n, '[^\\x00-\\x7F]') THEN 1 END) AS non_ascii_name, count(CASE WHEN regexp_matches(a, '^[0-9]') THEN 1 END) AS address_digit,
CAST(sum(length(n)) AS DOUBLE) / count(*) AS mean_name_length, CAST(sum(length(a)) AS DOUBLE) / count(*) AS mean_address_length, round(quantile_cont(length(n), 0.5), 3) AS p50_name_length, round(quantile_cont(length(n), 0.95), 3) AS p95_name_length, 'documents' AS file FROM p""")
def q_profile(spark, sf):
    out = quality.profile_all({"documents": _profiled(spark, sf)})
    return out.withColumns({n: F.round(n, 3) for n in ("p50_name_length", "p95_name_length")})


@query(f"WITH {_PROFILED} SELECT country, count(*) AS n FROM p GROUP BY country")
def q_profile_countries(spark, sf):
    return quality.country_counts(_profiled(spark, sf))


@query(f"""WITH {CUSTOMERS}, l AS (SELECT source1_entity_id, list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') AS l FROM truth_lists), u AS (SELECT id, count(DISTINCT source1_entity_id) AS k FROM (SELECT source1_entity_id, unnest(l) AS id FROM l) GROUP BY 1),
h AS (SELECT count(*) AS n_rows, count(CASE WHEN len(l) = 0 THEN 1 END) AS singletons, CAST(sum(len(l)) AS BIGINT) AS total_matches, CAST(max(len(l)) AS INT) AS max_matches FROM l)
SELECT *, 100e0 * singletons / n_rows AS singleton_percent, CAST(total_matches AS DOUBLE) / n_rows AS mean_matches, (SELECT count(*) FROM u) AS unique_ids, (SELECT count(CASE WHEN k > 1 THEN 1 END) FROM u) AS shared_ids FROM h""")
def q_gt_profile(spark, sf):
    return quality.truth_profile(Customers(spark, sf).truth_lists)


@query(f"WITH {CUSTOMERS} SELECT CAST(len(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '')) AS INT) AS n_matches, count(*) AS n_rows FROM truth_lists GROUP BY 1")
def q_gt_distribution(spark, sf):
    return quality.truth_distribution(Customers(spark, sf).truth_lists)


@query(f"WITH {CUSTOMERS}, k AS (SELECT cand_id FROM o WHERE o_orderkey % 10 <> 3), m AS (SELECT DISTINCT cand_id FROM truth WHERE cand_id NOT IN (SELECT cand_id FROM k)) SELECT 'S2' AS source, count(CASE WHEN starts_with(cand_id, 'S2-') THEN 1 END) AS n_missing FROM m UNION ALL SELECT 'S3', count(CASE WHEN starts_with(cand_id, 'S3-') THEN 1 END) FROM m")
def q_gt_membership(spark, sf):
    c = Customers(spark, sf)
    known = c.orders.where("o_orderkey % 10 <> 3").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "S2-").otherwise("S3-"), F.col("o_orderkey")).alias("entity_id"))
    return quality.missing_references(c.truth, known, known)


@query("""SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN l >= 160 THEN '160+' WHEN l >= 80 THEN '80-159' WHEN l >= 40 THEN '40-79' WHEN l >= 20 THEN '20-39' WHEN l >= 10 THEN '10-19' WHEN l >= 5 THEN '5-9' WHEN l >= 1 THEN '1-4' WHEN l >= 0 THEN '0-0' END AS bucket
FROM (SELECT length(text) AS l FROM conversations)) WHERE bucket IS NOT NULL GROUP BY bucket""")
def q_histogram(spark, sf):
    return quality.histogram(read(spark, sf, "conversations").select(F.length("text").alias("l")), "l")


# a list table with planted faults
_FAULTY = f"""{CUSTOMERS}, li AS (SELECT source1_entity_id AS s1_id, CASE WHEN hash_k % 50 = 1 THEN matched_entity_ids || ',' || source1_entity_id WHEN hash_k % 50 = 2 THEN matched_entity_ids || ',X9-1' WHEN hash_k % 50 = 3 THEN matched_entity_ids || ',S2-0,S2-0' ELSE matched_entity_ids END AS ids
FROM (SELECT *, CAST(substring(source1_entity_id, 4) AS BIGINT) AS hash_k FROM truth_lists) WHERE hash_k % 50 <> 4 UNION ALL SELECT source1_entity_id, matched_entity_ids FROM truth_lists WHERE CAST(substring(source1_entity_id, 4) AS BIGINT) % 50 = 5 UNION ALL SELECT 'S1-none', ''),
it AS (SELECT s1_id, list_filter(string_split(ids, ','), lambda x: trim(x) <> '') AS l FROM li), ea AS (SELECT s1_id, unnest(l) AS id FROM it),
fi AS (SELECT 'duplicate_row' AS rule, s1_id AS offender FROM it GROUP BY s1_id HAVING count(*) > 1 UNION SELECT 'duplicate_id', s1_id FROM it WHERE len(l) <> len(list_distinct(l)) UNION SELECT 'self_match', id FROM ea WHERE starts_with(id, 'S1-')
UNION SELECT 'wrong_prefix', id FROM ea WHERE NOT regexp_matches(id, '^S[123]-') UNION SELECT 'missing_row', s1_id FROM s1 WHERE s1_id NOT IN (SELECT s1_id FROM it) UNION SELECT 'unexpected_row', s1_id FROM it WHERE s1_id NOT IN (SELECT s1_id FROM s1)
UNION SELECT 'unknown_id', id FROM ea WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT cand_id FROM o))"""


def _faulty(c):
    k = F.substring("source1_entity_id", 4, 20).cast("long") % 50
    add = lambda s: F.concat("matched_entity_ids", s)
    ids = F.when(k == 1, add(F.concat(F.lit(","), "source1_entity_id"))).when(k == 2, add(F.lit(",X9-1"))).when(k == 3, add(F.lit(",S2-0,S2-0"))).otherwise(F.col("matched_entity_ids"))
    one = c.truth_lists.where(k != 4).select(F.col("source1_entity_id").alias("s1_id"), ids.alias("ids"))
    two = c.truth_lists.where(k == 5).select(F.col("source1_entity_id").alias("s1_id"), F.col("matched_entity_ids").alias("ids"))
    none = c.truth_lists.sparkSession.range(1).select(F.lit("S1-none").alias("s1_id"), F.lit("").alias("ids"))
    return one.unionByName(two).unionByName(none)


def _findings(c):
    return quality.validate_lists(_faulty(c), c.s1, c.records.select(F.col("entity_id").alias("id")))


@query(f"WITH {_FAULTY} SELECT 'error' AS severity, rule, offender FROM fi")
def q_validate(spark, sf):
    return _findings(Customers(spark, sf))


@query(f"WITH {_FAULTY} SELECT 'error' AS severity, rule, offender FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY offender) AS rn FROM fi) WHERE rn <= 5")
def q_validate_examples(spark, sf):
    return quality.examples(_findings(Customers(spark, sf)))


@query(f"WITH {_FAULTY} SELECT count(*) AS n_rows, count(CASE WHEN trim(ids) = '' THEN 1 END) AS n_empty, count(CASE WHEN trim(ids) <> '' THEN 1 END) AS n_filled, (SELECT count(*) FROM fi) AS n_errors, CASE WHEN (SELECT count(*) FROM fi) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM li")
def q_validate_summary(spark, sf):
    c = Customers(spark, sf)
    return quality.list_summary(_faulty(c), _findings(c))


@query(f"WITH {CUSTOMERS}, {_MATCHES} SELECT 'warning' AS severity, 'not_candidate' AS rule, s1_id || '|' || cand_id AS offender FROM matches ANTI JOIN (SELECT * FROM candidates WHERE pass_id <> 1) USING (s1_id, cand_id)")
def q_not_candidates(spark, sf):
    c = Customers(spark, sf)
    return quality.not_candidates(_matches(c), c.candidates.where("pass_id <> 1"))


@query("SELECT c_custkey || ' ' || c_name AS value FROM customer WHERE c_custkey % 7 <> 0")
def q_malformed_rows(spark, sf):
    c = read(spark, sf, "customer")
    sep = F.when(F.col("c_custkey") % 7 == 0, "\t").otherwise(" ")
    return quality.malformed_rows(c.select(F.concat(F.col("c_custkey"), sep, F.col("c_name")).alias("value")))


@query()
def q_gbt_scores(spark, sf):
    from erlink.operators.model import train_trees

    c = Customers(spark, sf)
    rows = c.scored.withColumn("f1", F.col("prob") % 100).withColumn("f2", F.col("prob").cast("double"))
    _, report = train_trees(rows.drop("prob"), ["f1", "f2"], trees=5, depth=3)
    return report
