"""Shared plumbing of the corpus operators: tables, shared storage, Arrow batches and bucketed blobs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass works on; longer texts get a pass of their own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame, *names: str) -> list[str]:
    """The names with a tail that keeps them apart from the columns of ``df``, whatever those are called."""
    taken, tail = {c.lower() for c in df.columns}, "_"
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one temporary folder per application where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        app = spark.sparkContext.applicationId
        at = _OWN.setdefault(app, _OWN.get(app) or tempfile.mkdtemp(prefix="erlink-"))
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/erlink-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def n_buckets(spark: SparkSession) -> int:
    """Buckets of the hash-partitioned exchanges; the cluster sizes them by ``spark.sql.shuffle.partitions``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidy() -> None:
    """Gives memory that this worker no longer uses back to the machine; allocators keep the peak of every earlier task otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts of a batch with at most ``limit`` text bytes (or a single row) each."""
    col = batch.column(batch.schema.get_field_index(text))
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    total = np.cumsum(size)
    while at < batch.num_rows:
        base = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def map_text(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, limit: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over text-sized cuts of each partition; ``df`` holds just the columns that ``fn`` reads."""

    def run(batches):
        for batch in batches:
            for cut in slices(batch, text, limit):
                yield fn(cut)
        tidy()

    return df.mapInArrow(run, schema)


# ---- number lists as compact blobs -------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes (only as many as the largest needs), compressed."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(v).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:5], "little")
    if not n:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[5:], max_output_size=width * n), dtype=np.uint8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as packed differences."""
    v = np.asarray(values, dtype=np.uint64)
    return pack(np.diff(v, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def gathered(df: DataFrame, buckets: int, bucket: str = "bucket") -> DataFrame:
    """Rows of a bucket number go to the partition of that number."""
    return df.repartitionById(buckets, df[bucket])
