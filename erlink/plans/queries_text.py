"""Queries over the text and address functions and the scans."""

from pyspark.sql import functions as F

from erlink.functions import address, strsim, text
from erlink.functions.constants import LANDMARK_WORDS, STREET_SUFFIXES, SUFFIX_CLASSES, US_STATES
from erlink.operators.prepare import prepare
from erlink.plans.registry import query
from erlink.plans.roles import read
from erlink.sources import tables

_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CLEAN = r"trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}\p{{M}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_CLEAN.format('lower(text)')} AS cleaned FROM documents")
def q_clean_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.clean_chars(F.lower("text")).alias("cleaned"))


@query("SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 1 AND t NOT IN ('the','and','of','for','at','in','on','a','an','to','co')), ' ') AS tokens FROM part")
def q_tokens(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.array_join(text.name_tokens(F.lower("p_name")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split({_CLEAN.format('lower(text)')}, ' '), lambda t: t <> ''))), ' ') AS tokens FROM documents")
def q_idf_token_set(spark, sf):
    norm = text.clean_chars(F.lower("text"))
    return read(spark, sf, "documents").select("doc_id", F.array_join(text.idf_tokens(norm), " ").alias("tokens"))


@query(r"""WITH l AS (SELECT doc_id, regexp_replace(text, '[^\p{L}]', '', 'g') AS s FROM documents),
f AS (SELECT doc_id, s, regexp_matches(s, '[\x{0000}-\x{024F}]') AS la, regexp_matches(s, '[\x{0900}-\x{0D7F}]') AS ind, regexp_matches(s, '[^\x{0000}-\x{024F}\x{0900}-\x{0D7F}]') AS oth FROM l)
SELECT doc_id, CASE WHEN s = '' THEN 'none' WHEN oth OR (la AND ind) THEN 'mixed' WHEN la THEN 'latin' ELSE 'indic' END AS script FROM f""")
def q_script(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.script_of(F.col("text")).alias("script"))


_NAMES = "(SELECT p_partkey AS k, lower(p_name) || CASE p_partkey % 5 WHEN 0 THEN ' pvt ltd' WHEN 1 THEN ' inc' WHEN 2 THEN ' private limited' WHEN 3 THEN '' ELSE ' gmbh' END AS name FROM part)"
_SUFFIX = "|".join(SUFFIX_CLASSES)


@query(f"""SELECT k, regexp_replace(name, '(?:^| )(?:{_SUFFIX})(?: (?:{_SUFFIX}))*$', '') AS stripped,
coalesce(CASE regexp_extract(name, '(?:^| )({_SUFFIX})$', 1) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in SUFFIX_CLASSES.items())} END, '') AS suffix_class FROM {_NAMES}""")
def q_suffix(spark, sf):
    end = F.when(F.col("p_partkey") % 5 == 0, " pvt ltd").when(F.col("p_partkey") % 5 == 1, " inc").when(F.col("p_partkey") % 5 == 2, " private limited").when(F.col("p_partkey") % 5 == 3, "").otherwise(" gmbh")
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lower("p_name"), end).alias("name"))
    return rows.select("k", text.strip_suffix(F.col("name")).alias("stripped"), text.suffix_class(F.col("name")).alias("suffix_class"))


@query("SELECT n_nationkey, lower(trim(n_name)) AS country, coalesce(n_name, '') AS key FROM nation")
def q_country_key(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", text.country_key(F.col("n_name")).alias("country"), text.text_key(F.col("n_name")).alias("key"))


@query("SELECT p_partkey, 'passage: ' || p_name || ' | ' || p_brand AS entity_text, 'passage: ' || p_name AS name_text FROM part")
def q_entity_text(spark, sf):
    cols = [F.col("p_name"), F.col("p_name"), F.col("p_brand"), F.col("p_brand")]
    return read(spark, sf, "part").select("p_partkey", text.entity_text(*cols, "entity").alias("entity_text"), text.entity_text(*cols, "name").alias("name_text"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM pages")
def q_bench_norm(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.bench_norm(F.col("url")).alias("norm"))


_STATES = list(US_STATES.values())
_ADDRESS_SQL = """SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE (CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_size || ' ' END) || lower(p_name) || CASE p_partkey % 4 WHEN 0 THEN ' street near' WHEN 1 THEN ' road' ELSE ' rue' END
|| CASE p_partkey % 5 WHEN 0 THEN ' north carolina' WHEN 1 THEN ' tx' WHEN 2 THEN ' kerala' WHEN 3 THEN ' madhya pradesh' ELSE ' bretagne' END || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 10000 + p_partkey ELSE 462000 + p_partkey END END AS norm,
CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country FROM part"""


def _addresses(spark, sf):
    k = F.col("p_partkey")
    pick = lambda n, values, other: F.expr(f"CASE p_partkey % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + f" ELSE '{other}' END")
    house = F.when(k % 3 == 0, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" ")))
    code = F.when(k % 2 == 0, 10000 + k).otherwise(462000 + k).cast("string")
    full = F.concat(house, F.lower("p_name"), pick(4, [" street near", " road"], " rue"), pick(5, [" north carolina", " tx", " kerala", " madhya pradesh"], " bretagne"), F.lit(" "), code)
    return read(spark, sf, "part").select(k.alias("k"), F.when(k % 11 == 0, "").otherwise(full).alias("norm"), pick(3, ["US", "India"], "France").alias("country"))


@query(f"""WITH a AS (SELECT *, list_filter(string_split(norm, ' '), lambda t: t <> '') AS t FROM ({_ADDRESS_SQL})),
h AS (SELECT *, CASE WHEN regexp_matches(coalesce(t[1], ''), '^[0-9]') THEN t[1] ELSE '' END AS house_no FROM a)
SELECT k, house_no, array_to_string(list_filter(t, lambda x: x NOT IN ({_quoted(STREET_SUFFIXES)}) AND x <> house_no)[1:12], ' ') AS street,
CASE country WHEN 'India' THEN regexp_extract(norm, '\\b\\d{{6}}\\b', 0) ELSE regexp_extract(norm, '\\b\\d{{5}}\\b', 0) END AS postal,
coalesce(list_filter(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), lambda p: p IN ({_quoted(address.TWO_WORD_STATES)}))[1],
  CASE WHEN list_filter(t, lambda x: x IN ({_quoted(address.ONE_WORD_STATES + list(US_STATES))}))[1] IN ({_quoted(US_STATES)}) THEN map {{{', '.join(f"'{a}': '{b}'" for a, b in US_STATES.items())}}}[list_filter(t, lambda x: x IN ({_quoted(address.ONE_WORD_STATES + list(US_STATES))}))[1]]
  ELSE list_filter(t, lambda x: x IN ({_quoted(address.ONE_WORD_STATES + list(US_STATES))}))[1] END, '') AS state_key,
array_to_string(CASE WHEN len(t) > 6 THEN t[len(t) - 5:] ELSE t END, ' ') AS city, len(list_filter(t, lambda x: x IN ({_quoted(LANDMARK_WORDS)}))) > 0 AS landmark_flag, norm = '' AS addr_missing FROM h""")
def q_address_parse(spark, sf):
    a = _addresses(spark, sf).withColumn("a", address.parse_address(F.col("norm"), F.col("norm"), F.col("country")))
    return a.select("k", "a.house_no", F.array_join("a.street_tokens", " ").alias("street"), "a.postal", "a.state_key", F.array_join("a.city_tokens", " ").alias("city"), "a.landmark_flag", "a.addr_missing")


@query("SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def q_row_counts(spark, sf):
    out = None
    for t in ("customer", "orders", "lineitem"):
        row = tables.read_parquet(spark, f"{sf}/{t}.parquet").agg(F.count("*").alias("n")).select(F.lit(t).alias("t"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT entity_id, min(name) AS name FROM (SELECT c_custkey % 100 AS entity_id, c_name AS name FROM customer UNION ALL SELECT s_suppkey % 100, s_name FROM supplier) WHERE entity_id IS NOT NULL GROUP BY entity_id")
def q_unique_entities(spark, sf):
    c = read(spark, sf, "customer").select((F.col("c_custkey") % 100).alias("entity_id"), F.col("c_name").alias("name"))
    s = read(spark, sf, "supplier").select((F.col("s_suppkey") % 100).alias("entity_id"), F.col("s_name").alias("name"))
    return tables.unique_entities(c, s)


@query("SELECT DISTINCT trim(c_mktsegment) AS id FROM customer WHERE trim(c_mktsegment) <> ''")
def q_id_set(spark, sf):
    return tables.id_set(read(spark, sf, "customer"), "c_mktsegment")


@query()
def q_normalize_unicode(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.name_forms("text").alias("f")).select("doc_id", "f.*")


@query()
def q_prepare(spark, sf):
    p = read(spark, sf, "part")
    raw = p.select(F.concat(F.lit("S2-"), F.col("p_partkey")).alias("entity_id"), F.col("p_name").alias("business_name"), F.concat_ws(" ", F.col("p_size").cast("string"), "p_type", F.lit("street, tx")).alias("business_address"), F.lit("US").alias("country"))
    return prepare(raw)


@query()
def q_fuzzy_scores(spark, sf):
    a = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.lag("p_name").over(__import__("pyspark").sql.Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).where("b is not null")
    return a.withColumn("s", strsim.string_scores("a", "b")).select("k", "a", "b", "s.*")


@query("""SELECT k, a, b, CAST(floor(1e6 * jaro_winkler_similarity(a, b) + 0.5e0) AS BIGINT) AS jaro FROM (
SELECT p_partkey AS k, p_name AS a, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL""")
def q_jaro(spark, sf):
    a = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.lag("p_name").over(__import__("pyspark").sql.Window.partitionBy("p_brand").orderBy("p_partkey")).alias("b")).where("b is not null")
    return a.withColumn("jaro", F.floor(1e6 * strsim.jaro_winkler_of("a", "b") + 0.5).cast("long"))
