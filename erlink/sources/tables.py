"""Readers and writers of record files, and small checks on them."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """Tab-separated text with a header, all strings, no quoting; empty fields are '' and not null."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("encoding", "UTF-8")
    return (reader.schema(schema).csv(list(paths)) if schema else reader.option("inferSchema", False).csv(list(paths))).na.fill("")


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    return read_tsv(spark, *paths, schema=RECORDS)


def read_truth(spark: SparkSession, *paths: str) -> DataFrame:
    return read_tsv(spark, *paths, schema=TRUTH)


def read_csv_by_name(spark: SparkSession, *paths: str, sep: str = ",") -> DataFrame:
    """Several files as one bag, columns matched by name, all strings; absent columns are null."""
    frames = [spark.read.option("header", True).option("sep", sep).csv(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Files, folders or globs as one bag."""
    return spark.read.parquet(*paths)


def first_existing(*paths: str) -> str:
    """The first path that exists, for sources with a fallback."""
    for p in paths:
        if os.path.exists(p):
            return p
    raise FileNotFoundError(", ".join(paths))


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def id_set(df: DataFrame, column: str | None = None) -> DataFrame:
    """Distinct trimmed non-blank ids of the first (or a named) column."""
    c = F.trim(F.col(column or df.columns[0]))
    return df.select(c.alias("id")).where("id <> ''").distinct()


def country_map(*sources: DataFrame) -> DataFrame:
    """(entity_id, country) with the country as it stands."""
    out = sources[0].select("entity_id", "country")
    for s in sources[1:]:
        out = out.unionByName(s.select("entity_id", "country"))
    return out


def unique_entities(*sources: DataFrame) -> DataFrame:
    """One row per non-null entity id over all sources; of differing values the smallest is taken."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.where("entity_id is not null").groupBy("entity_id").agg(*[F.min(c).alias(c) for c in out.columns if c != "entity_id"])


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_partitioned(df: DataFrame, path: str, key: str, parts: int) -> None:
    """Rows of one key in one file: dealt by the key's hash into ``parts`` partitions."""
    df.repartition(parts, key).write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Header, tabs, no quoting: an empty value is a truly empty field."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def write_report(df: DataFrame, path: str) -> dict:
    """A one-row report as a JSON file written by the driver."""
    row = df.first().asDict(recursive=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, indent=2, default=str)
    return row


def stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The stored result of a stage where it exists, else made, stored and read back."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        write_parquet(make(), path)
    return spark.read.parquet(path)
