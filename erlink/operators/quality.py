"""Profiles of record sources and truth, and checks of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: edges of the length histogram
LENGTH_EDGES = [0, 1, 5, 10, 20, 40, 80, 160]


def profile(records: DataFrame, file: str) -> DataFrame:
    """One row: rows, distinct and repeated ids, empty fields, question-mark runs, non-ASCII names, addresses that begin with a digit, length figures."""
    name, addr = F.coalesce("business_name", F.lit("")), F.coalesce("business_address", F.lit(""))
    n = lambda c: F.count(F.when(c, 1))
    mean = lambda c: F.try_divide(F.sum(F.length(c)).cast("double"), F.count("*"))
    return records.agg(
        F.count("*").alias("n_rows"), F.countDistinct("entity_id").alias("unique_ids"), (F.count("*") - F.countDistinct("entity_id")).alias("duplicate_ids"),
        n(F.trim(name) == "").alias("empty_name"), n(F.trim(addr) == "").alias("empty_address"), n(F.trim(F.coalesce("country", F.lit(""))) == "").alias("empty_country"),
        n(name.rlike(r"\?{2,}") | addr.rlike(r"\?{2,}")).alias("question_marks"), n(name.rlike(r"[^\x00-\x7F]")).alias("non_ascii_name"), n(addr.rlike(r"^[0-9]")).alias("address_digit"),
        mean(name).alias("mean_name_length"), mean(addr).alias("mean_address_length"), F.percentile(F.length(name), 0.5).alias("p50_name_length"), F.percentile(F.length(name), 0.95).alias("p95_name_length"),
    ).withColumn("file", F.lit(file))


def country_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("country").agg(F.count("*").alias("n"))


def profile_all(sources: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sources.items():
        row = profile(df, name)
        out = row if out is None else out.unionByName(row)
    return out


def truth_profile(truth: DataFrame) -> DataFrame:
    """One row: lists, singletons and their per cent, matches in all, mean, most, distinct ids, ids in more than one list."""
    items = F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")
    per = truth.select("source1_entity_id", F.size(items).alias("n"))
    used = truth.select("source1_entity_id", F.explode(items).alias("id")).groupBy("id").agg(F.countDistinct("source1_entity_id").alias("k"))
    ids = used.agg(F.count("*").alias("unique_ids"), F.count(F.when(F.col("k") > 1, 1)).alias("shared_ids"))
    head = per.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("n") == 0, 1)).alias("singletons"), F.sum("n").alias("total_matches"), F.max("n").alias("max_matches"))
    head = head.withColumn("singleton_percent", F.try_divide(F.lit(100.0) * F.col("singletons"), "n_rows")).withColumn("mean_matches", F.try_divide(F.col("total_matches").cast("double"), "n_rows"))
    return head.crossJoin(F.broadcast(ids))  # single rows


def truth_distribution(truth: DataFrame) -> DataFrame:
    """(n_matches, n_rows)."""
    return truth.select(F.size(F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")).alias("n_matches")).groupBy("n_matches").agg(F.count("*").alias("n_rows"))


def missing_references(truth_pairs: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """(source, n_missing): ids of the truth with the source's prefix that the source lacks."""
    out = None
    for prefix, df in (("S2", s2), ("S3", s3)):
        ids = truth_pairs.where(F.col("cand_id").startswith(prefix + "-")).select("cand_id").distinct()
        row = ids.join(df.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_anti").agg(F.count("*").alias("n_missing")).select(F.lit(prefix).alias("source"), "n_missing")
        out = row if out is None else out.unionByName(row)
    return out


def histogram(values: DataFrame, column: str, edges: list[int] | None = None) -> DataFrame:
    """(bucket, n): counts between fixed edges; the last bucket is open, values below the first edge are left out."""
    edges = edges or LENGTH_EDGES
    label = F.lit(None).cast("string")
    for lo, hi in zip(edges, [*edges[1:], None]):
        inside = (F.col(column) >= lo) if hi is None else (F.col(column) >= lo) & (F.col(column) < hi)
        label = F.when(inside, f"{lo}+" if hi is None else f"{lo}-{hi - 1}").otherwise(label)
    return values.select(label.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def check_header(lines: list[str], expected: tuple[str, str]) -> list[str]:
    """What is wrong with the first line of a file (its lines so far)."""
    if not lines:
        return ["empty file"]
    head = lines[0].rstrip("\r\n")
    if "\t" not in head and "," in head:
        return ["COMMA-separated header; tabs are needed"]
    if [h.strip().lower() for h in head.split("\t")] != list(expected):
        return [f"header must be {expected}"]
    return []


def malformed_rows(lines: DataFrame) -> DataFrame:
    """Non-blank lines (value) without a tab."""
    return lines.where((F.trim("value") != "") & ~F.col("value").contains("\t"))


def validate_lists(lists: DataFrame, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(severity, rule, offender) of a list table (s1_id, ids as a comma list).

    Rules: duplicate left rows, repeated ids in a list, left ids as matches,
    other prefixes, unknown ids (with ``known``), missing and unexpected left ids.
    """
    items = lists.select("s1_id", F.filter(F.split(F.coalesce("ids", F.lit("")), ","), lambda x: F.trim(x) != "").alias("l"))
    each = items.select("s1_id", F.explode("l").alias("id"))
    error = lambda df, rule, who: df.select(F.lit("error").alias("severity"), F.lit(rule).alias("rule"), F.col(who).cast("string").alias("offender")).distinct()
    found = [
        error(items.groupBy("s1_id").count().where("count > 1"), "duplicate_row", "s1_id"),
        error(items.where(F.size("l") != F.size(F.array_distinct("l"))), "duplicate_id", "s1_id"),
        error(each.where(F.col("id").startswith("S1-")), "self_match", "id"),
        error(each.where(~F.col("id").rlike("^S[123]-")), "wrong_prefix", "id"),
        error(required.select("s1_id").join(items, "s1_id", "left_anti"), "missing_row", "s1_id"),
        error(items.join(required.select("s1_id"), "s1_id", "left_anti"), "unexpected_row", "s1_id"),
    ]
    if known is not None:
        found.append(error(each.where(F.col("id").rlike("^S[23]-")).join(known.select("id"), "id", "left_anti"), "unknown_id", "id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Warnings for matched pairs that are no candidate pairs."""
    pair = F.concat_ws("|", "s1_id", "cand_id")
    return matches.join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti").select(F.lit("warning").alias("severity"), F.lit("not_candidate").alias("rule"), pair.alias("offender"))


def list_summary(lists: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: rows, empty and filled lists, errors, PASS or FAIL."""
    empty = F.trim(F.coalesce("ids", F.lit(""))) == ""
    head = lists.agg(F.count("*").alias("n_rows"), F.count(F.when(empty, 1)).alias("n_empty"), F.count(F.when(~empty, 1)).alias("n_filled"))
    errors = findings.where("severity = 'error'").agg(F.count("*").alias("n_errors"))
    out = head.crossJoin(F.broadcast(errors))  # single rows
    return out.withColumn("verdict", F.when(F.col("n_errors") == 0, "PASS").otherwise("FAIL"))


def examples(findings: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` offenders of each rule in order."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("severity", "rule").orderBy("offender"))
    return findings.withColumn("rn", rn).where(F.col("rn") <= n).drop("rn")
