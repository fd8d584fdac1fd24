"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is cut into ``BLOCKS`` blocks of 2-bit segments; the vector of the
segments' bit counts is its embedding.  The Manhattan distance of two
embeddings is a lower bound of the fingerprints' Hamming distance, so links
are found by a range join of the embeddings: at distance <= radius at least
BLOCKS - radius blocks of the vectors are equal, so each choice of that many
blocks is a grid whose cells hold all pairs that it must find.  Inside a cell
pairs are cut by the Manhattan bound and verified on the exact fingerprints.

Equal fingerprints are one node, so a group of copies is one row.  A cell
emits a spanning forest of its links, never all its pairs: large cells are
walked breadth-first, where every node that has been reached leaves the set
that is still compared.

Defined cases: null text counts as empty; texts without words have
fingerprint zero and link like any other; repeated rows are returned each;
ties go to the smallest doc_id; null doc_ids are kept and get the component of
their fingerprint's smallest doc_id (null if there is none); an empty table
gives no rows; other columns are not read.  The pipeline's stage takes the same embedding with wider
fingerprints and verifies links on the shingles (``neardup``).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.llm.common import map_text, n_buckets, stored, table
from erlink.llm.components import components
from erlink.llm.textvec import NON_SPACE, split_words

BLOCKS = 8
RADIUS = 4
#: Cells up to this size compare all their pairs at once; larger ones are walked.
DENSE = 64


def fingerprints(texts, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats included (A-Z lower-cased)."""
    w = split_words(texts, NON_SPACE, lower=True)
    n = len(w.first) - 1
    # words of a text joined by one space: a shingle is then one slice of bytes
    raw = w.data.tobytes()
    out = np.zeros(n, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    for d in range(n):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if a == b:
            continue
        words = [raw[s:e] for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist())]
        line = b" ".join(words)
        length = np.fromiter(map(len, words), dtype=np.int64, count=b - a) + 1
        start = np.concatenate([[0], np.cumsum(length)])
        k = min(shingle, b - a)
        lo, hi = start[: b - a - k + 1].tolist(), (start[k:] - 1).tolist()
        h = np.fromiter([digest(line[s:e], seed) for s, e in zip(lo, hi)], dtype=np.uint64, count=len(lo))
        out[d] = _majority(h)
    return out


def _majority(h: np.ndarray) -> np.uint64:
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (a signed long with the 64 bits) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist()).view(np.int64))], names=["doc_id", "fp"])

    return map_text(docs.select("doc_id", "text"), "text", run, "doc_id bigint, fp bigint")


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in two bits of the result."""
    five = np.uint64(0x5555555555555555)
    return (fp & five) + ((fp >> np.uint64(1)) & five)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of embeddings: counts are 0, 1 or 2, written in unary so that it is a bit count."""
    return np.bitwise_count(_unary(x) ^ _unary(y))


def _unary(x: np.ndarray) -> np.ndarray:
    five = np.uint64(0x5555555555555555)
    low, high = x & five, (x >> np.uint64(1)) & five
    return (low | high) | (high << np.uint64(1))


def grid_cells(fp: np.ndarray, blocks: int = BLOCKS, radius: int = RADIUS) -> np.ndarray:
    """(choices, len(fp)) keys: per choice of blocks - radius blocks the embedding there, mixed with the choice's number."""
    width = 64 // blocks
    e = embed(fp)
    part = [(e >> np.uint64(width * b)) & np.uint64((1 << width) - 1) for b in range(blocks)]
    out = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = np.full(len(fp), k, dtype=np.uint64)
        for b in chosen:
            key = key << np.uint64(width) | part[b]
        out.append(key)
    return np.stack(out)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Manhattan bound on the embeddings first, the exact distance on what is left."""
    near = manhattan(embed(a), embed(b)) <= radius
    at = np.flatnonzero(near)
    near[at] = np.bitwise_count((a if len(a) > 1 else np.broadcast_to(a, len(near)))[at] ^ (b if len(b) > 1 else np.broadcast_to(b, len(near)))[at]) <= radius
    return near


def cell_links(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of each cell's members; rows are sorted by cell here."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, dtype=np.int64)
    size = np.diff(edge)
    left, right = [], []
    small = np.repeat((size > 1) & (size <= DENSE), size)
    k, f = key[small], fp[small]
    for step in range(1, DENSE):  # pairs of rows that are `step` apart
        at = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else np.empty(0, dtype=np.int64)
        if not len(at):
            break
        a, b = f[at], f[at + step]
        ok = _near(a, b, radius) if len(at) > 1 else np.bitwise_count(a ^ b) <= radius
        left.append(a[ok])
        right.append(b[ok])
    for c in np.flatnonzero(size > DENSE):
        left_c, right_c = _walk(fp[edge[c] : edge[c + 1]], radius)
        left.append(left_c)
        right.append(right_c)
    if not left:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    return _forest(np.concatenate(left), np.concatenate(right))


def _walk(members: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first search of one cell; each node is compared with the nodes not yet reached."""
    rest = np.unique(members)
    left, right = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            ok = np.bitwise_count(rest ^ x) <= radius
            found = rest[ok]
            if len(found):
                left.append(np.full(len(found), x))
                right.append(found)
                queue += list(found)
                rest = rest[~ok]
    if not left:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A subset of the links with the same components (at most nodes - 1 links)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.get(top, top)) != top:
            top = p
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep.append(i)
    return a[keep], b[keep]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (u, v) between distinct fingerprints that span their components; ``fps`` has one column, fp, of distinct values."""
    spark = fps.sparkSession

    def cells(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for k in range(0, len(fp), 20_000):
                part = fp[k : k + 20_000]
                grid = grid_cells(part.view(np.uint64), blocks, radius)
                yield pa.RecordBatch.from_arrays([pa.array(grid.ravel().view(np.int64)), pa.array(np.tile(part, len(grid)))], names=["cell", "fp"])

    def links(batches):
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64)) for b in batches]
        if parts:
            u, v = cell_links(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    grid = fps.mapInArrow(cells, "cell bigint, fp bigint")
    return grid.repartition(2 * n_buckets(spark), "cell").mapInArrow(links, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of every row."""
    prints = stored(fingerprint_table(docs), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(prints.select("fp").distinct(), radius)
    group = components(links)  # by fingerprint
    linked = group.join(least, group["node"] == least["fp"])
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    of = linked.join(smallest, "component").select("fp", "component_id")
    class_of = least.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    from erlink.llm.neardup import split_join

    return split_join(prints, class_of, "fp")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of texts of five-word Jaccard similarity 0.8 or more one row stays.

    See ``neardup``: null and empty texts are copies of each other, equal rows
    become one, rows without an id take part, empty docs give no rows, all
    columns are kept.
    """
    from erlink.llm.neardup import kept_rows

    return kept_rows(docs)
