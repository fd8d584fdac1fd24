"""Prepared records from a folder that keeps receiving record files: the same operator on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from erlink.operators.prepare import prepare
from erlink.sources.tables import RECORDS


def prepared_stream(spark: SparkSession, folder: str) -> DataFrame:
    reader = spark.readStream.schema(RECORDS).option("sep", "\t").option("header", True).option("quote", "")
    return prepare(reader.csv(folder).na.fill(""))


def write_stream(stream: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet; the checkpoint lets a restart go on where it was."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
