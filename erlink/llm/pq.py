"""Embedding near-dedup by product quantisation.

A coarse quantiser (k-means on a bounded sample) deals unit vectors into
inverted lists; residuals are coded per subspace against codebooks fitted on
the same sample.  A query visits every list that can hold a partner: by the
distance to the plane between two centroids, a list farther than the link
radius holds none, so the probes are sufficient by construction, not by
tuning.  In a list, distances of the query to the coded vectors are summed
from per-subspace tables; a vector stays a candidate where that distance less
its own coding error is within the radius (a lower bound of the true
distance), and candidates are reranked by the exact cosine in double
precision.  The fit decides speed only: no bound depends on the sample.

Equal vectors of a label are one class with a count.  Lists are cut into
chunks of at most about ``CHUNK`` vectors, which get the list's queries each,
so that no task holds an unbounded list; a chunk sends the counts and a
spanning set of its links, never all pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without label or id, link with nothing (their component
is their own id); vectors of different lengths never link, and lengths other
than the sample's commonest share one list per length; repeated rows count as
other vectors; ties of ids are one node; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.llm.common import n_buckets, stored, table
from erlink.llm.components import components, spanning

COSINE = 0.98
#: Distinct vectors that quantiser and codebooks are fitted on, those of smallest hash.
SAMPLE = 8192
SUBSPACES, CODEWORDS = 8, 64
CHUNK = 4096
_SLACK = 1e-5  # for rounding; the exact cosine decides


@dataclass
class Quantiser:
    dim: int
    centroids: np.ndarray  # (cells, dim)
    gap: np.ndarray  # distances between centroids
    cuts: list[tuple[int, int]]  # columns of each subspace
    books: list[np.ndarray]  # (codewords, columns) for each subspace


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, index of the nearest)."""
    d = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)
    return d, d.argmin(1)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        _, a = _nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, cells: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> Quantiser:
    c = kmeans(sample, cells)
    _, a = _nearest(sample, c)
    residual = sample - c[a]
    edge = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    cuts = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    return Quantiser(sample.shape[1], c, np.sqrt(_nearest(c, c)[0]), cuts, [kmeans(residual[:, p:q], codewords) for p, q in cuts])


def probes(q: Quantiser, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each vector, mask of the cells that can hold a vector within ``radius`` of it)."""
    d, home = _nearest(x, q.centroids)
    over = d - d[np.arange(len(x)), home][:, None]
    return home, over <= 2 * (radius + _SLACK) * q.gap[home] + _SLACK


def encode(q: Quantiser, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code per subspace, length of what the code leaves out)."""
    codes = np.empty((len(residual), len(q.cuts)), dtype=np.uint8)
    error = np.zeros(len(residual))
    for s, (a, b) in enumerate(q.cuts):
        d, k = _nearest(residual[:, a:b], q.books[s])
        codes[:, s] = k
        error += d[np.arange(len(k)), k]
    return codes, np.sqrt(error)


def table_distances(q: Quantiser, cell: int, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Distances of the queries ``x`` to the coded vectors of a cell, summed from one table per subspace."""
    residual = x - q.centroids[cell]
    out = np.zeros((len(x), len(codes)))
    for s, (a, b) in enumerate(q.cuts):
        out += _nearest(residual[:, a:b], q.books[s])[0][:, codes[:, s]]
    return np.sqrt(out)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def classes(vectors: DataFrame) -> DataFrame:
    """(rep, label, dim, vector, mult) of each distinct vector of a label that can link; vector is the components as floats."""
    good = vectors.where("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0")
    good = good.where(~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("embedding", lambda e: e != 0))
    return good.groupBy("label", F.col("embedding").cast("array<double>").alias("vector")).agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).select("rep", "label", F.size("vector").alias("dim"), "vector", "mult")


def default_cells(n: int) -> int:
    return int(min(256, max(1, round(n**0.5 / 8))))


def links(found: DataFrame, cosine: float = COSINE, cells: int | None = None) -> DataFrame:
    """Rows (kind, a, b): kind 0 says that class ``a`` is linked to ``b`` other vectors here, kind 1 is a link of classes."""
    spark = found.sparkSession
    n = found.count()
    top = found.orderBy(F.xxhash64("rep"), "rep").select("dim", "vector").limit(SAMPLE).toArrow()  # SAMPLE vectors at most
    dims = top.column("dim").to_numpy()
    main = int(np.bincount(dims).argmax()) if len(dims) else 1
    sample = np.array([v for v in top.column("vector").to_pylist() if len(v) == main]) if len(dims) else np.ones((1, 1))
    held = spark.sparkContext.broadcast(fit(_unit(sample), cells or default_cells(n)))
    radius = float(np.sqrt(2 - 2 * cosine))

    def deal(batches):
        q = held.value
        for batch in batches:
            vectors, rep, label, mult = batch.column(3), batch.column(0).to_numpy(), batch.column(1), batch.column(4).to_numpy()
            dim = batch.column(2).to_numpy()
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                for k in range(0, len(rows), 2000):
                    at = rows[k : k + 2000]
                    raw = vectors.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)
                    if d == q.dim:
                        home, mask = probes(q, _unit(raw), radius)
                    else:
                        home, mask = np.full(len(at), -int(d)), None
                    i, cell = np.nonzero(mask) if mask is not None else (np.arange(len(at)), home)
                    role = np.concatenate([np.zeros(len(at), dtype=np.int32), np.ones(len(i), dtype=np.int32)])
                    who = np.concatenate([np.arange(len(at)), i])
                    blob = [r.tobytes() for r in raw]
                    cols = [label.take(pa.array(at[who])), pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(role), pa.array(rep[at[who]]), pa.array(mult[at[who]]), pa.array([blob[w] for w in who], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["label", "cell", "role", "rep", "mult", "vector"])

    label_type = found.schema["label"].dataType.simpleString()
    dealt = found.mapInArrow(deal, f"label {label_type}, cell int, role int, rep bigint, mult bigint, vector binary")
    chunks = dealt.where("role = 0").groupBy("label", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = dealt.join(chunks, ["label", "cell"])  # queries of cells without a list drop out
    chunk = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = dealt.withColumn("chunk", F.explode(chunk)).drop("chunks").select("label", "cell", "chunk", "role", "rep", "mult", "vector")
    dealt = dealt.repartition(2 * n_buckets(spark), "label", "cell", "chunk").sortWithinPartitions("label", "cell", "chunk", "role")

    def compare(batches):
        q, key, parts, members = held.value, None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3))))
            edge = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(edge, edge[1:]):
                if a == b:
                    continue
                now, role = keys[a][:3], keys[a][3]
                if now != key:
                    key, parts, members = now, [], None
                raw = np.frombuffer(b"".join(batch.column(6).slice(a, b - a).to_pylist()), dtype=np.float64).reshape(b - a, -1)
                rep, mult = batch.column(4).slice(a, b - a).to_numpy(), batch.column(5).slice(a, b - a).to_numpy()
                if role == 0:
                    parts.append((raw, rep, mult))
                    continue
                if members is None:
                    members = _Members(q, key[1], *(np.concatenate(x) for x in zip(*parts)))
                for k in range(0, b - a, 256):
                    yield from members.answer(raw[k : k + 256], rep[k : k + 256], cosine, radius)

    return dealt.mapInArrow(compare, "kind int, a bigint, b bigint")


class _Members:
    """A chunk of an inverted list."""

    def __init__(self, q: Quantiser, cell: int, raw: np.ndarray, rep: np.ndarray, mult: np.ndarray):
        self.q, self.cell, self.raw, self.rep, self.mult = q, cell, raw, rep, mult
        self.norm = np.sqrt((raw * raw).sum(1))
        if cell >= 0:
            self.codes, self.error = encode(q, raw / self.norm[:, None] - q.centroids[cell])

    def answer(self, raw: np.ndarray, rep: np.ndarray, cosine: float, radius: float):
        norm = np.sqrt((raw * raw).sum(1))
        if self.cell >= 0:
            near = table_distances(self.q, self.cell, raw / norm[:, None], self.codes) - self.error <= radius + _SLACK
            i, j = np.nonzero(near)
        else:
            i, j = (x.ravel() for x in np.indices((len(raw), len(self.raw))))
        hit = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), 1 << 16):  # exact rerank
            s = slice(k, k + (1 << 16))
            hit[s] = (raw[i[s]] * self.raw[j[s]]).sum(1) / (norm[i[s]] * self.norm[j[s]]) >= cosine
        hit &= rep[i] != self.rep[j]
        i, j = i[hit], j[hit]
        if len(i):
            count = np.bincount(i, weights=self.mult[j], minlength=len(raw)).astype(np.int64)
            some = np.flatnonzero(count)
            u, v = spanning(rep[i], self.rep[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(some), len(u)]).astype(np.int32)), pa.array(np.concatenate([rep[some], u])), pa.array(np.concatenate([count[some], v]))], names=["kind", "a", "b"])


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cells: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    vectors = vectors.select("vec_id", "embedding", "label")
    found = stored(classes(vectors), "classes")
    rows = stored(links(found, cosine, cells), "vector-links")
    counts = rows.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
    group = components(rows.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnsRenamed({"node": "g", "component": "c"})
    of = found.join(counts, F.col("rep") == F.col("a"), "left").join(group, F.col("rep") == F.col("g"), "left")
    of = of.select(F.col("label").alias("l"), "vector", "mult", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("c", "rep").alias("c"))
    vector = F.col("embedding").cast("array<double>")
    joined = vectors.join(of, (F.col("label") == F.col("l")) & (vector == F.col("vector")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("c", "vec_id")
    n = F.coalesce(F.col("mult") - 1 + F.col("others"), F.lit(0)).cast("long")
    return joined.select("vec_id", n.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings`` within labels."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
