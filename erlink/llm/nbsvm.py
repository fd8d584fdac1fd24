"""Quality classifier: naive Bayes support vectors.

Texts become sets of hashed n-gram indicators: word unigrams, word bigrams and
byte 4-grams of the lower-cased text.  Each indicator is scaled by its class
log-count ratio, and a linear hinge-loss model is fitted on the scaled
indicators by dual coordinate descent (Hsieh et al. 2008); a logistic curve
fitted on out-of-fold margins maps margins to 0..1.

The fit uses a bounded sample of labelled rows: the ``max_rows`` rows of
smallest hash, which reads labels of all rows but texts of the sample only.
Scoring is one pass over whole texts.

Defined cases: null text counts as empty; an empty text has no indicators and
gets the score of the intercept; a document labelled more than once takes its
smallest label; null labels are unlabelled; where the sample lacks a class,
every score is the share of label 1 (0.5 without labels); repeated documents
are scored each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.llm.common import map_text, table, tidy
from erlink.llm.textvec import NON_SPACE, inside_documents, mix, sequence_hashes, split_words, word_hashes

BITS = 18
MAX_ROWS = 4000
THRESHOLD = 0.3
#: Text bytes that indicators are taken of at once: each byte starts a 4-gram, whose arrays take about a hundred times as much.
PART = 1 << 20


def indicators(texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, features): the ascending distinct features of each text, one after the other."""
    w = split_words(texts, NON_SPACE, lower=True)
    n, shift = len(w.first) - 1, np.uint64(64 - bits)
    h = word_hashes(w)
    two = inside_documents(w, 2)
    codes = [(w.doc.astype(np.int64) << bits) | (mix(h) >> shift).astype(np.int64), (w.doc[two].astype(np.int64) << bits) | (sequence_hashes(h, 2)[two] >> shift).astype(np.int64)]
    if len(w.data) >= 4:
        b = w.data.astype(np.uint64)
        gram = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24)
        doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(w.edge))[: len(gram)]
        last = w.edge[1:][doc] - 1  # the separator after the text
        inside = np.arange(len(gram)) + 3 < last
        codes.append((doc[inside] << bits) | (mix(gram[inside] + np.uint64(1)) >> shift).astype(np.int64))
    all_codes = np.concatenate(codes)
    all_codes.sort()
    if len(all_codes):
        all_codes = all_codes[np.concatenate([[True], all_codes[1:] != all_codes[:-1]])]
    return np.searchsorted(all_codes, np.arange(n + 1, dtype=np.int64) << bits), all_codes & ((1 << bits) - 1)


def log_ratios(offsets: np.ndarray, features: np.ndarray, y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed class counts p (label 1) and q (label 0) of each indicator."""
    row = np.repeat(y.astype(np.int8), np.diff(offsets))
    p = np.bincount(features[row == 1], minlength=size) + alpha
    q = np.bincount(features[row == 0], minlength=size) + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(offsets: np.ndarray, features: np.ndarray, scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L2-regularised L1-loss support vector machine; rows are scaled to unit length."""
    n, sign = len(y), np.where(y == 1, 1.0, -1.0)
    rows = [features[a:b] for a, b in zip(offsets, offsets[1:])]
    values = []
    for r in rows:
        v = scale[r]
        norm = np.sqrt((v * v).sum())
        values.append(v / norm if norm else v)
    square = np.array([(v * v).sum() + 1.0 for v in values])  # the intercept is a feature of value 1
    weights, intercept, dual = np.zeros(len(scale)), 0.0, np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            r, v = rows[i], values[i]
            slope = sign[i] * (weights[r] @ v + intercept) - 1.0
            new = min(max(dual[i] - slope / square[i], 0.0), cost[i])
            if (step := (new - dual[i]) * sign[i]) != 0.0:
                weights[r] += step * v
                intercept += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    return weights, intercept


@dataclass
class Model:
    """``weight`` has the log-count ratios multiplied in; the margin divides by the length of the scaled row."""

    weight: np.ndarray
    ratio2: np.ndarray
    intercept: float
    slope: float
    shift: float
    bits: int

    def margins(self, offsets: np.ndarray, features: np.ndarray) -> np.ndarray:
        # a sum per row of its own, so that a score doesn't depend on the rows beside it
        first, some = offsets[:-1], np.diff(offsets) > 0
        dot, norm = np.zeros(len(first)), np.zeros(len(first))
        if some.any():
            dot[some] = np.add.reduceat(self.weight[features], first[some])
            norm[some] = np.add.reduceat(self.ratio2[features], first[some])
        return np.where(norm > 1e-12, dot / np.sqrt(np.maximum(norm, 1e-12)), 0.0) + self.intercept

    def scores(self, texts) -> np.ndarray:
        z = self.slope * self.margins(*indicators(texts, self.bits)) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve by Newton steps, with his smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        theta += step
        if abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def fit(offsets: np.ndarray, features: np.ndarray, y: np.ndarray, bits: int = BITS, cost: float = 1.0, folds: int = 3) -> Model:
    """The model of labelled sets of indicators; both classes weigh the same."""
    size, zero = 1 << bits, np.zeros(1 << bits)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(zero, zero, 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), bits)

    def part(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if keep.all():
            return offsets, features, y
        length = np.diff(offsets)[keep]
        taken = np.repeat(keep, np.diff(offsets))
        return np.concatenate([[0], np.cumsum(length)]), features[taken], y[keep]

    def one(o, f, t) -> Model:
        ratio = log_ratios(o, f, t, size)
        weigh = np.where(t == 1, len(t) / (2 * max(1, (t == 1).sum())), len(t) / (2 * max(1, (t == 0).sum()))) * cost
        w, b = dual_descent(o, f, ratio, t, weigh)
        return Model(w * ratio, ratio * ratio, b, 1.0, 0.0, bits)

    fold, margin = np.arange(len(y)) % folds, np.zeros(len(y))
    order = np.argsort(y, kind="stable")  # each fold gets its share of both classes
    group = np.empty(len(y), dtype=np.int64)
    group[order] = fold
    for k in range(folds):
        if len(set(y[group != k].tolist())) == 2:
            m = one(*part(group != k))
            o, f, _ = part(group == k)
            margin[group == k] = m.margins(o, f)
    model = one(*part(np.ones(len(y), dtype=bool)))
    model.slope, model.shift = _logistic(margin, y)
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> Model:
    """Fits on the ``max_rows`` labelled documents of smallest hash (all of them where there are fewer)."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    picked = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows small rows are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        o, f = indicators(batch.column(2).to_pylist(), bits)
        lists = [f[a:b].astype("<i4").tobytes() for a, b in zip(o, o[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary())], names=["doc_id", "y", "features"])

    got = map_text(rows, "text", sets, "doc_id bigint, y int, features binary", PART)
    # repeated ids and rows take part once, so that the sample stays bounded
    got = got.groupBy("doc_id").agg(F.min(F.struct("y", "features")).alias("r")).select("doc_id", "r.y", "r.features").toArrow().sort_by("doc_id")
    y = np.array(got.column("y").to_pylist(), dtype=np.int64)
    parts = [np.frombuffer(b, dtype="<i4") for b in got.column("features").to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    features = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
    del got, parts
    model = fit(offsets, features, y, bits)
    tidy()  # the driver goes on with other stages
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; the model (4 MB) goes out once to each executor."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return map_text(docs.select("doc_id", "text"), "text", run, "doc_id bigint, score double", PART)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train_part(df: DataFrame) -> DataFrame:
    return df.where(~held_out(F.col("doc_id")))


def op1_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of the held-out fifth are never read into the fit."""
    docs = table(spark, sf_dir, "documents")
    model = train(train_part(docs), train_part(table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; all columns stay.

    The text is scored in place, beside its row, so that no join back is needed.
    Null and empty texts get the intercept's score; repeated rows and null
    doc_ids are scored like others; without labels every row stays (a score of
    0.5); empty docs give no rows; all columns are kept.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    held = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(held.value.scores(batch.column(batch.schema.names.index("text")).to_pylist()) >= THRESHOLD))

    return map_text(docs, "text", run, docs.schema, PART)
