"""Multi-pass blocking with size caps.

Oversized keys are dropped before the join, so a common key never multiplies:
the cap test sees key rows of the candidate side only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erlink.functions.constants import MIN_IDF, PAIR_CAP, PASS_CAPS, PASS_SCORES


def token_idf(*records: DataFrame) -> DataFrame:
    """(token, df, idf): ln(rows / entities with the token) over the bag of all sources."""
    bag = records[0].select("entity_id", "name_idf_tokens")
    for r in records[1:]:
        bag = bag.unionByName(r.select("entity_id", "name_idf_tokens"))
    n = bag.agg(F.count("*").alias("n"))
    per = bag.select("entity_id", F.explode("name_idf_tokens").alias("token")).groupBy("token").agg(F.countDistinct("entity_id").alias("df"))
    return per.crossJoin(F.broadcast(n)).select("token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))  # one row is broadcast


def _key(pass_id: int, key: Column, score: Column | None = None, when: Column | None = None) -> Column:
    made = F.struct(F.lit(pass_id).cast("tinyint").alias("pass_id"), key.alias("key"), (F.lit(PASS_SCORES.get(pass_id)) if score is None else score).cast("float").alias("block_score"))
    return made if when is None else F.when(when, made)


def _each(pass_id: int, items: Column, key, score=None, keep=None) -> Column:
    chosen = F.filter(items, keep) if keep is not None else items
    return F.transform(chosen, lambda x: _key(pass_id, key(x), None if score is None else score(x)))


def block_keys(records: DataFrame, idf: DataFrame | None = None, min_idf: float = MIN_IDF) -> DataFrame:
    """(entity_id, pass_id, key, block_score) of all passes; one explode of an array of keys per record.

    Tokens without an idf count 0, so without a map every record falls back to
    the passes that need none.  Records lacking name_idf_tokens use name_tokens.
    """
    names = "name_idf_tokens" if "name_idf_tokens" in records.columns else "name_tokens"
    rows = records.select(
        "entity_id", F.coalesce("name_norm", F.lit("")).alias("norm"), F.array_distinct(F.coalesce(F.col(names), F.array().cast("array<string>"))).alias("names"),
        F.coalesce("house_no", F.lit("")).alias("house"), F.coalesce("street_tokens", F.array().cast("array<string>")).alias("street"), F.coalesce("postal", F.lit("")).alias("postal"), F.coalesce("state_key", F.lit("")).alias("state"),
    )
    pair = F.struct(F.coalesce("idf", F.lit(0.0)).alias("idf"), F.col("token").alias("token"))
    exploded = rows.select("entity_id", F.explode("names").alias("token"))
    weighed = exploded.join(idf.select("token", "idf"), "token", "left") if idf is not None else exploded.withColumn("idf", F.lit(0.0))
    weights = weighed.groupBy("entity_id").agg(F.sort_array(F.collect_list(pair), asc=False).alias("weighed"))  # a name's few tokens
    rows = rows.join(weights, "entity_id", "left").withColumn("weighed", F.coalesce("weighed", F.array().cast("array<struct<idf:double,token:string>>")))
    rows = rows.withColumn("top", F.transform(F.slice("weighed", 1, 4), lambda x: x.token))
    norm_tokens = F.filter(F.split("norm", " "), lambda t: t != "")
    first = F.coalesce(F.get(norm_tokens, F.lit(0)), F.lit(""))
    rare = F.exists("weighed", lambda x: x.idf >= min_idf)
    joined = lambda *x: F.array_join(F.array_sort(F.array(*x)), "|")
    twos = F.flatten(F.transform("top", lambda a, i: F.transform(F.slice("top", i + 2, 4), lambda b: _key(9, joined(a, b)))))
    top = F.col("top")
    keys = F.concat(
        F.array(
            _key(1, F.col("norm")),
            _key(4, F.concat("house", F.lit("|"), F.substring(F.get("street", F.lit(0)), 1, 5)), when=(F.col("house") != "") & (F.size("street") > 0)),
            _key(5, F.concat(F.col("postal"), F.lit("|"), first), when=(F.col("postal") != "") & (first != "")),
            _key(6, F.concat(F.col("state"), F.lit("|"), F.substring("norm", 1, 3)), when=~rare & (F.size(norm_tokens) <= 2) & (F.col("norm") != "")),
            _key(10, joined(F.get(top, F.lit(0)), F.get(top, F.lit(1)), F.get(top, F.lit(2))), when=F.size("top") >= 3),
        ),
        _each(3, F.col("weighed"), lambda x: x.token, lambda x: x.idf, lambda x: x.idf >= min_idf),
        _each(7, F.col("names"), lambda t: F.substring(t, 1, 5), keep=lambda t: F.length(t) >= 5),
        _each(8, F.array_distinct("street"), lambda t: F.substring(t, 1, 5), keep=lambda t: F.length(t) >= 5),
        twos,
    )
    return rows.select("entity_id", F.explode(keys).alias("k")).where("k is not null").select("entity_id", "k.pass_id", "k.key", "k.block_score").where("key <> ''")


def caps_of(overrides: dict | None = None) -> dict[int, int]:
    return PASS_CAPS | {int(k): int(v) for k, v in (overrides or {}).items()}


def valid_keys(cand_keys: DataFrame, caps: dict[int, int] | None = None) -> DataFrame:
    """(pass_id, key, n) of keys within their pass's cap; passes without one take the largest."""
    caps = caps or PASS_CAPS
    cap = F.lit(max(caps.values()))
    for p, c in caps.items():
        cap = F.when(F.col("pass_id") == p, c).otherwise(cap)
    return cand_keys.where("key <> ''").groupBy("pass_id", "key").agg(F.count("*").alias("n")).where(F.col("n") <= cap)


def block_join(s1_keys: DataFrame, cand_keys: DataFrame, caps: dict[int, int] | None = None) -> DataFrame:
    """(s1_id, cand_id, pass_id, block_score) of records that share a valid key."""
    ok = cand_keys.join(valid_keys(cand_keys, caps), ["pass_id", "key"], "left_semi")
    left = s1_keys.where("key <> ''").select(F.col("entity_id").alias("s1_id"), "pass_id", "key", "block_score")
    return left.join(ok.select(F.col("entity_id").alias("cand_id"), "pass_id", "key"), ["pass_id", "key"]).select("s1_id", "cand_id", "pass_id", "block_score")


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """Smallest pass and largest score of each pair, each on its own."""
    return pairs.groupBy("s1_id", "cand_id").agg(F.min("pass_id").alias("pass_id"), F.max("block_score").alias("block_score"))


def is_s2(c: Column) -> Column:
    return c.startswith("S2-")


def cap_pairs(pairs: DataFrame, cap: int = PAIR_CAP) -> DataFrame:
    order = Window.partitionBy("s1_id").orderBy("pass_id", F.desc("block_score"), "cand_id")
    return pairs.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap).drop("rn")


def candidates(s1_keys: DataFrame, cand_keys: DataFrame, cap: int = PAIR_CAP, caps: dict[int, int] | None = None) -> DataFrame:
    """(s1_id, cand_id, pass_id, block_score, is_s2): capped candidate pairs."""
    return cap_pairs(dedup_pairs(block_join(s1_keys, cand_keys, caps)), cap).withColumn("is_s2", is_s2(F.col("cand_id")))


def generate_candidates(s1: DataFrame, cands: DataFrame, cap: int = PAIR_CAP, caps: dict[int, int] | None = None, min_idf: float = MIN_IDF) -> DataFrame:
    """Candidates straight from prepared records."""
    has = "name_idf_tokens" in s1.columns and "name_idf_tokens" in cands.columns
    idf = token_idf(s1, cands) if has else None
    return candidates(block_keys(s1, idf, min_idf), block_keys(cands, idf, min_idf), cap, caps)


def bench_key(country: Column, norm: Column) -> Column:
    """country | first token of four or more characters, else its first three."""
    first = F.coalesce(F.get(F.filter(F.split(norm, " "), lambda t: t != ""), F.lit(0)), F.lit(""))
    return F.concat(country, F.lit("|"), F.when(F.length(first) >= 4, first).otherwise(F.substring(first, 1, 3)))
