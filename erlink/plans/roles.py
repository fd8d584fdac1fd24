"""Record-linkage roles played by the driver tables, in Spark and as the same CTEs in SQL.

``customers``: left records are customers, candidates orders, truth the
customers' own orders of status F, scores integer per mille.  ``hosts``: left
records are the first page of each host, candidates all pages, names their
whole addresses, truth the pages of the same host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.functions import text


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Customers:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.customer, self.orders, self.nation = (read(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
        self.s1 = self.customer.select(F.concat(F.lit("S1-"), F.col("c_custkey")).alias("s1_id"))
        nation = self.nation.select("n_nationkey", F.lower("n_name").alias("country"))
        self.countries = self.customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("S1-"), F.col("c_custkey")).alias("entity_id"), "country")  # 25 nations
        prefix = F.when(F.col("o_orderkey") % 2 == 0, "S2-").otherwise("S3-")
        o = self.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.concat(prefix, F.col("o_orderkey")).alias("cand_id"), F.expr("o_custkey div 5").alias("b"))
        c = self.customer.select("c_custkey", F.concat(F.lit("S1-"), F.col("c_custkey")).alias("s1_id"), F.expr("c_custkey div 5").alias("b"))
        own = F.col("o_custkey") == F.col("c_custkey")
        prob = (F.col("o_orderkey") * 7919 + F.col("c_custkey") * 104729) % 600 + F.when(own, 399).otherwise(0)
        self.scored = o.join(c, "b").select("s1_id", "cand_id", prob.cast("long").alias("prob"), (own & (F.col("o_orderstatus") == "F")).cast("int").alias("label"), ((F.col("o_orderkey") + F.col("c_custkey")) % 3 + 1).cast("int").alias("pass_id"))
        self.pairs = self.scored.select("s1_id", "cand_id")
        self.truth = o.where("o_orderstatus = 'F'").select(F.concat(F.lit("S1-"), F.col("o_custkey")).alias("s1_id"), "cand_id")
        self.candidates = self.scored.where("prob >= 300").select("s1_id", "cand_id", "pass_id")
        lists = self.truth.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list("cand_id")), ",").alias("l"))
        self.truth_lists = self.s1.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("l", F.lit("")).alias("matched_entity_ids"))
        self.records = o.select(F.col("cand_id").alias("entity_id"))


CUSTOMERS = """
s1 AS (SELECT 'S1-' || c_custkey AS s1_id FROM customer),
countries AS (SELECT 'S1-' || c_custkey AS entity_id, lower(n_name) AS country FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT o_orderkey, o_custkey, o_orderstatus, (CASE WHEN o_orderkey % 2 = 0 THEN 'S2-' ELSE 'S3-' END) || o_orderkey AS cand_id FROM orders),
scored AS (SELECT 'S1-' || c_custkey AS s1_id, cand_id, CAST((o_orderkey * 7919 + c_custkey * 104729) % 600 + CASE WHEN o_custkey = c_custkey THEN 399 ELSE 0 END AS BIGINT) AS prob,
  CAST(CASE WHEN o_custkey = c_custkey AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS label, CAST((o_orderkey + c_custkey) % 3 + 1 AS INT) AS pass_id
  FROM o JOIN customer ON o_custkey // 5 = c_custkey // 5),
truth AS (SELECT 'S1-' || o_custkey AS s1_id, cand_id FROM o WHERE o_orderstatus = 'F'),
candidates AS (SELECT s1_id, cand_id, pass_id FROM scored WHERE prob >= 300),
truth_lists AS (SELECT s1.s1_id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY cand_id), '') AS matched_entity_ids FROM s1 LEFT JOIN truth USING (s1_id) GROUP BY 1)"""


_SCHEME, _HOST, _LANG = "^[a-z]+://", "^[a-z]+://([^/?#]+)", "^[a-z]+://[^/]+/([a-z]{2})/"


def _records(df: DataFrame, prefix) -> DataFrame:
    norm = text.clean_chars(F.lower(F.regexp_replace("url", _SCHEME, "")))
    out = df.select(F.concat(prefix, F.col("page_id")).alias("entity_id"), norm.alias("name_norm"), F.col("page_id").alias("k"), F.col("lang").alias("state_key"))
    return out.select(
        "entity_id", "name_norm", text.name_tokens(F.col("name_norm")).alias("name_tokens"), text.idf_tokens(F.col("name_norm")).alias("name_idf_tokens"), text.script_of(F.col("name_norm")).alias("name_script"),
        (F.col("k") % 10).cast("string").alias("house_no"), F.lpad((F.col("k") % 50 * 1013).cast("string"), 5, "0").alias("postal"), "state_key", F.slice(text.tokens(F.col("name_norm")), 1, 3).alias("street_tokens"),
        F.col("name_norm").alias("addr_norm"), (F.col("name_norm") == "").alias("addr_raw_missing"), (F.col("k") % 4 == 0).alias("landmark_flag"), F.col("state_key").alias("country"),
    )


class Hosts:
    def __init__(self, spark: SparkSession, sf_dir: str):
        pages = read(spark, sf_dir, "pages")
        self.pages = pages.select("page_id", "url", F.regexp_extract("url", _HOST, 1).alias("host"), F.regexp_extract("url", _LANG, 1).alias("lang"))
        self.prefix = F.when(F.col("page_id") % 2 == 0, "S2-").otherwise("S3-")
        self.first = self.pages.groupBy("host").agg(F.min("page_id").alias("page_id"))
        self.s1 = _records(self.pages.join(self.first.select("page_id"), "page_id", "left_semi"), F.lit("S1-"))
        self.cands = _records(self.pages, self.prefix)

    @property
    def truth(self) -> DataFrame:
        first = self.first.select("host", F.concat(F.lit("S1-"), F.col("page_id")).alias("s1_id"))
        return self.pages.join(first, "host").select("s1_id", F.concat(self.prefix, F.col("page_id")).alias("cand_id"))


def _records_sql(table: str, prefix: str) -> str:
    return f"""SELECT *, list_filter(string_split(name_norm, ' '), lambda t: length(t) > 1 AND t NOT IN ('the','and','of','for','at','in','on','a','an','to','co')) AS name_tokens,
  list_sort(list_distinct(toks)) AS name_idf_tokens, toks[1:3] AS street_tokens FROM (SELECT *, list_filter(string_split(name_norm, ' '), lambda t: t <> '') AS toks FROM (
  SELECT {prefix} || page_id AS entity_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(url, '{_SCHEME}', '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name_norm,
  CAST(page_id % 10 AS VARCHAR) AS house_no, lpad(CAST(page_id % 50 * 1013 AS VARCHAR), 5, '0') AS postal, lang AS state_key, page_id % 4 = 0 AS landmark_flag FROM {table}))"""


_PREFIX = "(CASE WHEN page_id % 2 = 0 THEN 'S2-' ELSE 'S3-' END)"
HOSTS = f"""
pg AS (SELECT page_id, url, regexp_extract(url, '{_HOST}', 1) AS host, regexp_extract(url, '{_LANG}', 1) AS lang FROM pages),
leaders AS (SELECT host, min(page_id) AS page_id FROM pg GROUP BY host),
s1 AS ({_records_sql("(SELECT * FROM pg SEMI JOIN leaders USING (page_id))", "'S1-'")}),
cands AS ({_records_sql("pg", _PREFIX)}),
bag AS (SELECT entity_id, name_idf_tokens FROM s1 UNION ALL SELECT entity_id, name_idf_tokens FROM cands),
idf AS (SELECT token, count(DISTINCT entity_id) AS df, ln(CAST((SELECT count(*) FROM bag) AS DOUBLE) / count(DISTINCT entity_id)) AS idf FROM (SELECT entity_id, unnest(name_idf_tokens) AS token FROM bag) GROUP BY token)"""


def keys_sql(src: str) -> str:
    """All blocking passes of a record CTE, as one SELECT."""
    return f"""
{src}_tok AS (SELECT entity_id, token, coalesce(idf, 0e0) AS idf FROM (SELECT entity_id, unnest(name_idf_tokens) AS token FROM {src}) LEFT JOIN idf USING (token)),
{src}_rank AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY idf DESC, token DESC) AS rn FROM {src}_tok),
{src}_rare AS (SELECT DISTINCT entity_id FROM {src}_tok WHERE idf >= 4e0),
{src}_street AS (SELECT DISTINCT entity_id, unnest(street_tokens) AS token FROM {src}),
{src}_keys AS (SELECT entity_id, CAST(pass_id AS TINYINT) AS pass_id, key, CAST(block_score AS FLOAT) AS block_score FROM (
  SELECT entity_id, 1 AS pass_id, name_norm AS key, 1e0 AS block_score FROM {src}
  UNION ALL SELECT entity_id, 3, token, idf FROM {src}_tok WHERE idf >= 4e0
  UNION ALL SELECT entity_id, 4, house_no || '|' || substring(street_tokens[1], 1, 5), 0.8e0 FROM {src} WHERE house_no <> '' AND len(street_tokens) > 0
  UNION ALL SELECT entity_id, 5, postal || '|' || toks[1], 0.7e0 FROM {src} WHERE postal <> '' AND len(toks) > 0
  UNION ALL SELECT entity_id, 6, state_key || '|' || substring(name_norm, 1, 3), 0.5e0 FROM {src} WHERE len(toks) <= 2 AND name_norm <> '' AND entity_id NOT IN (SELECT entity_id FROM {src}_rare)
  UNION ALL SELECT entity_id, 7, substring(token, 1, 5), 0.75e0 FROM {src}_tok WHERE length(token) >= 5
  UNION ALL SELECT entity_id, 8, substring(token, 1, 5), 0.7e0 FROM {src}_street WHERE length(token) >= 5
  UNION ALL SELECT a.entity_id, 9, least(a.token, b.token) || '|' || greatest(a.token, b.token), 0.65e0 FROM {src}_rank a JOIN {src}_rank b ON a.entity_id = b.entity_id AND a.rn < b.rn AND b.rn <= 4
  UNION ALL SELECT entity_id, 10, string_agg(token, '|' ORDER BY token), 0.6e0 FROM {src}_rank WHERE rn <= 3 GROUP BY entity_id HAVING count(*) = 3
) WHERE key <> '')"""


CAPS = "CASE pass_id WHEN 1 THEN 5000 WHEN 3 THEN 200 WHEN 4 THEN 2000 WHEN 5 THEN 1000 WHEN 6 THEN 50 WHEN 7 THEN 500 WHEN 8 THEN 300 WHEN 9 THEN 100 WHEN 10 THEN 30 ELSE 5000 END"
BLOCKED = f"""{HOSTS},{keys_sql("s1")},{keys_sql("cands")},
valid AS (SELECT pass_id, key, count(*) AS n FROM cands_keys GROUP BY pass_id, key HAVING count(*) <= {CAPS}),
joined AS (SELECT s.entity_id AS s1_id, c.entity_id AS cand_id, s.pass_id, s.block_score FROM s1_keys s JOIN cands_keys c USING (pass_id, key) JOIN valid USING (pass_id, key)),
dedup AS (SELECT s1_id, cand_id, min(pass_id) AS pass_id, max(block_score) AS block_score FROM joined GROUP BY s1_id, cand_id),
pairs AS (SELECT s1_id, cand_id, pass_id, block_score, starts_with(cand_id, 'S2-') AS is_s2 FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY pass_id, block_score DESC, cand_id) AS rn FROM dedup) WHERE rn <= 200),
truth AS (SELECT 'S1-' || leaders.page_id AS s1_id, (CASE WHEN pg.page_id % 2 = 0 THEN 'S2-' ELSE 'S3-' END) || pg.page_id AS cand_id FROM pg JOIN leaders USING (host))"""
