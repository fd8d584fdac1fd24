"""Sharding by minimax contiguous partition, in DataFrame functions only.

Law ``bytes``: shard sizes are as near equal as whole groups of equal texts
allow.  Groups are gathered in ``UNITS`` hash cells, the ordered atomic units:
equal texts share a cell, so no group is cut.  The cells, largest first, are
cut into contiguous runs: binary search finds the smallest capacity for which
greedy filling needs no more shards than there are; the first run is cut
there, and the rest is searched again with one shard less, so that a huge
group leaves the others balanced.  The driver sees one number per cell
(``UNITS`` at most, whatever the input), and the cells' shards go out as one
literal of 4 bytes a cell.

Slots are numbered without a task per shard: rows of a shard are spread over
``SALTS`` hash groups, each group numbers its own rows, and the running total
of the group sizes (shards x SALTS rows) is added.

Defined cases: null text has size 1, like the empty text, whose group and
CRC (0) it shares; null doc_ids are rows like others; repeated rows get a
slot each; ties are broken by the columns, so equal rows may swap slots; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erlink.llm.common import table

UNITS = 16384
SALTS = 512


def fits(prefix: list[int], start: int, shards: int, capacity: int) -> bool:
    """Whether greedy filling from unit ``start`` on needs at most ``shards`` runs of ``capacity``."""
    n = len(prefix) - 1
    for _ in range(shards):
        if start >= n:
            return True
        start = bisect_right(prefix, prefix[start] + capacity, lo=start) - 1
    return start >= n


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """``shards`` + 1 ascending cut points; each run's capacity is the smallest that is feasible for what is left."""
    prefix, cuts, n = [0, *accumulate(sizes)], [0], len(sizes)
    for left in range(shards, 1, -1):
        start = cuts[-1]
        low, high = max(sizes[start:], default=0), prefix[n] - prefix[start]
        low = max(low, -(-high // left))
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if fits(prefix, start, left, mid) else (mid + 1, high)
        cuts.append(min(n, bisect_right(prefix, prefix[start] + low, lo=start) - 1))
    return [*cuts, n]


def shard_documents(docs: DataFrame, shards: int = 8, units: int = UNITS, salts: int = SALTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(units)).cast("int").alias("cell"),
    )
    totals = base.groupBy("cell").agg(F.sum("size").alias("bytes")).collect()  # at most `units` rows
    order = sorted(((r["bytes"], r["cell"]) for r in totals), key=lambda x: (-x[0], x[1]))
    cuts = minimax_cuts([b for b, _ in order], shards)
    code = bytearray(b"0000" * units)
    for s in range(shards):
        for _, cell in order[cuts[s] : cuts[s + 1]]:
            code[4 * cell : 4 * cell + 4] = b"%04d" % s
    placed = base.withColumn("shard", F.substring(F.lit(bytes(code)), F.col("cell") * 4 + 1, F.lit(4)).cast("string").cast("int"))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(salts)).cast("int"))
    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = counts.select("shard", "salt", (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size"))
    numbered = placed.withColumn("own", own).join(F.broadcast(before), ["shard", "salt"])  # shards x salts rows
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``bytes``."""
    return shard_documents(table(spark, sf_dir, "documents"))
