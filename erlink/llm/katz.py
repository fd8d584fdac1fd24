"""Language-model scores by Katz backoff over word bigrams.

P(w | v) = c*(v, w) / c(v) where the pair was seen, else bow(v) P(w); P(w) =
c*(w) / N where the word was seen, else the mass that is left, which belongs
to the one event "unknown word".  c* are Good-Turing discounted counts (Katz's
form for counts up to ``K``; larger ones lose ``EPSILON``, which keeps every
backoff weight positive), and bow(v) = (1 - sum of c*(v, w) / c(v)) / (1 - sum
of P(w)) over the w seen after v, so every distribution sums to one.

Documents are read once.  Each batch sends its distinct (context, word,
document) entries to partitions by word, with counts for training and scoring
alike.  A partition holds all entries of its words, so it knows c(w) and
c(v, w); since the discounts are not known yet, it writes what they will be
applied to: per document the number of tokens of each count class and sums of
logarithms, per context the number of successors of each class (the stored,
partitioned tables of the model), and the unseen pairs.  Counts of counts are
then added up, and partitions by context resolve backoff weights and answer
to the documents.  The recursion of each token thus takes its steps where the
tables lie, and no table is ever in one place.

Words that hold a large share of the tokens (``heavy``; a bounded number) are
counted beforehand and dealt by pair, so that no partition gets them whole.

Words are known by 64-bit hashes of their bytes: some two of n words share one
with a chance of about n * n / 2**65, which is 3 in 100 at 10**9 distinct words
(they would then count as one word).  Defined cases: null text counts as empty
(one token, the end); a null doc_id trains; repeated rows count and are scored
each; without training rows every token is the unknown word, of probability 1;
very long texts are a batch of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.llm.common import gathered, map_text, n_buckets, pack, pack_sorted, slices, stored, table, tidy, unpack, unpack_sorted
from erlink.llm.textvec import NON_SPACE, mix, split_words, word_hashes

K = 5
EPSILON = 0.01
BATCH_BYTES = 8 << 20
#: Codes of a text's end and of the context before its first word; other codes are the hashes of words' bytes.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Entries that a partition counts at a time.
PART = 250_000
_BASE, _SCORE = 1e8, 1e6  # sums of logarithms travel as integers of these units
_FLOW = "kind int, bucket int, batch bigint, parts array<binary>"
_DOCS, _PAIRS, _SUMS, _CONTEXTS, _UNSEEN, _COUNTS = range(6)


def _flow(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["kind", "bucket", "batch", "parts"])


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each run of equal rows, run number of each row) of sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _sum(values: np.ndarray, run: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(run, weights=values, minlength=n)


def _class(count: np.ndarray) -> np.ndarray:
    """0 for unseen, 1..K for these counts, K + 1 for larger ones."""
    return np.minimum(count, K + 1).astype(np.int64)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(x) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, document) of every token, ends included."""
    w = split_words(texts, NON_SPACE, lower=True)
    n = len(w.first) - 1
    doc = np.concatenate([w.doc, np.arange(n, dtype=np.int32)])
    order = np.argsort(doc, kind="stable")  # each end goes behind its document's words
    word = np.concatenate([word_hashes(w), np.full(n, END)])[order]
    doc = doc[order]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.searchsorted(doc, np.arange(n))] = START
    return word, context, doc


def _send(batch: pa.RecordBatch, number: int, buckets: int, heavy: np.ndarray):
    """Entries of a batch: to itself its documents, to each partition its share of the distinct (context, word, document)."""
    ids, held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
    word, context, doc = _tokens(batch.column(2).to_pylist())
    length = np.bincount(doc, minlength=len(held))
    null = np.asarray(ids.is_null()).astype(np.uint8)
    yield (_DOCS, number % buckets, number, [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), null.tobytes(), held.astype(np.uint8).tobytes(), pack(length)])
    deal = word.copy()
    spread = np.isin(word, heavy)
    deal[spread] = mix(word[spread] * np.uint64(3) + context[spread])
    to = _bucket(deal, buckets)
    order = np.lexsort((doc, context, word, to))
    to, word, context, doc = to[order], word[order], context[order], doc[order]
    first, run = _runs(word, context, doc)
    times = np.bincount(run)
    to, word, context, doc = to[first], word[first], context[first], doc[first]
    cut = np.searchsorted(to, np.arange(buckets + 1))
    for k in range(buckets):
        a, b = cut[k], cut[k + 1]
        if a < b:
            own, local = np.unique(context[a:b], return_inverse=True)
            yield (_PAIRS, k, number, [pack_sorted(word[a:b]), pack_sorted(own), pack(local), pack(doc[a:b] << 1 | held[doc[a:b]]), pack(times[a:b])])


def _reduced(key: np.ndarray, fields) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct keys, sums of the fields over each); a field at a time is put in order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first, _ = _runs(key)
    sums = [np.add.reduceat(f[order], first) if len(first) else f for f in fields]
    return key[first], np.stack(sums)


def _merged(one: tuple | None, two: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Two results of ``_reduced`` as one."""
    if one is None:
        return two
    return _reduced(np.concatenate([one[0], two[0]]), (np.concatenate(x) for x in zip(one[1], two[1])))


def _count_part(word, context, source, times, train, heavy: np.ndarray, heavy_count: np.ndarray):
    """(statistics, (documents, sums), (contexts, successor numbers), unseen (context, document, times)) of all entries of some words.

    ``source`` is batch index << 32 | document.
    """
    order = np.lexsort((context, word))
    word, context, source, times, train = word[order], context[order], source[order], times[order], train[order]
    taught = times * train
    pair_first, pair = _runs(word, context)
    pair_count = _sum(taught, pair, len(pair_first)).astype(np.int64)
    word_first, of_word = _runs(word)
    word_count = _sum(taught, of_word, len(word_first)).astype(np.int64)
    known_heavy = np.zeros(len(word_first), dtype=bool)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, word[word_first]), len(heavy) - 1)
        known_heavy = heavy[at] == word[word_first]
        word_count = np.where(known_heavy, heavy_count[at], word_count)
    light = word_count[~known_heavy]
    light = light[light > 0]
    seen_pairs = pair_count[pair_count > 0]
    stats = np.array([light.sum(), len(light), *np.bincount(_class(light), minlength=K + 3)[: K + 2], *np.bincount(seen_pairs[seen_pairs <= K + 1], minlength=K + 3)[: K + 2], (light == K + 1).sum()], dtype=np.int64)
    # sums per document
    cw, cp = word_count[of_word], pair_count[pair]
    seen, w_class, p_class = cp > 0, _class(cw), _class(cp)
    big_word, big_pair = np.log10(np.maximum(cw - EPSILON, 1)), np.log10(np.maximum(cp - EPSILON, 1))
    fields = [
        times * (cw > 0),
        times * np.log10(cw + 1.0) * _BASE,
        times * (np.where(seen, np.where(p_class > K, big_pair, 0.0), np.where(w_class > K, big_word, 0.0)) - np.log10(np.maximum(cw, 1)) * (word != END)) * _SCORE,
        *(times * (seen & (p_class == r)) for r in range(1, K + 1)),
        *(times * (~seen & (w_class == r)) for r in range(K + 2)),
    ]
    sums = _reduced(source, fields)
    # successors of each context, by class of the pair and of the word
    live = np.flatnonzero(pair_count > 0)
    r, c = pair_count[live], word_count[of_word[pair_first[live]]]
    numbers = [*(_class(r) == x for x in range(1, K + 2)), np.where(r > K, r, 0), *(_class(c) == x for x in range(1, K + 2)), np.where(c > K, c, 0)]
    contexts = _reduced(context[pair_first[live]], (x.astype(np.int64) for x in numbers))
    miss = np.flatnonzero(~seen)
    return stats, sums, contexts, (context[miss], source[miss], times[miss])


def _count(rows: list[tuple[int, list[bytes]]], bucket: int, buckets: int, heavy: np.ndarray, heavy_count: np.ndarray):
    """What one partition finds out about its words; see the module's text."""
    rows.sort(key=lambda x: x[0])
    batches = np.array([b for b, _ in rows], dtype=np.int64)
    word = [unpack_sorted(p[0]) for _, p in rows]
    parts = -(-sum(map(len, word)) // PART)
    edges = [int((1 << 64) * k // parts) for k in range(1, parts)]
    cuts = [[0, *np.searchsorted(w, np.array(edges, dtype=np.uint64)).tolist(), len(w)] for w in word]
    context = [unpack_sorted(p[1])[unpack(p[2]).astype(np.int64)] for _, p in rows]
    doc = [unpack(p[3]).astype(np.uint32) for _, p in rows]
    times = [unpack(p[4]).astype(np.int32) for _, p in rows]
    for _, p in rows:
        p.clear()  # the packed columns are read
    stats, sums, numbers, unseen = 0, None, None, []
    for k in range(parts):
        of = lambda x: np.concatenate([a[c[k] : c[k + 1]] for a, c in zip(x, cuts)])  # noqa: E731, B023
        d = of(doc)
        batch = np.repeat(np.arange(len(rows), dtype=np.int64), [c[k + 1] - c[k] for c in cuts])
        found = _count_part(of(word), of(context), batch << 32 | (d >> 1), of(times), (d & 1) == 0, heavy, heavy_count)
        stats = stats + found[0]
        sums, numbers = _merged(sums, found[1]), _merged(numbers, found[2])
        unseen.append(found[3])
    del word, context, doc, times, of, found
    tidy()
    yield (_COUNTS, bucket, -1, [stats.astype("<i8").tobytes()])
    source, sums = sums
    sums = np.rint(sums).astype(np.int64)
    sums[2] = sums[2] << 1 ^ sums[2] >> 63  # the one sum that may be negative
    cut = np.searchsorted(source, np.arange(len(rows) + 1) << 32)
    for k in range(len(rows)):
        s = slice(cut[k], cut[k + 1])
        if cut[k] < cut[k + 1]:
            yield (_SUMS, bucket, int(batches[k]), [pack_sorted(source[s] & 0xFFFFFFFF), *(pack(f[s].astype(np.uint64)) for f in sums)])
    v, numbers = numbers
    to = _bucket(v, buckets)
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cut[k] < cut[k + 1]:
            s = order[cut[k] : cut[k + 1]]
            yield (_CONTEXTS, k, bucket, [pack_sorted(v[s]), *(pack(x[s].astype(np.uint64)) for x in numbers)])
    del v, numbers
    # pairs that training hasn't seen, for the partitions of their contexts
    context, source, times = (np.concatenate([f[i] for f in unseen]) for i in range(3))
    to = _bucket(context, buckets)
    order = np.lexsort((source, context, to))
    context, source, times = context[order], source[order], times[order]
    cut = np.searchsorted(to[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cut[k] < cut[k + 1]:
            s = slice(cut[k], cut[k + 1])
            yield (_UNSEEN, k, bucket, [pack_sorted(context[s]), pack(source[s] >> 32), pack(source[s] & 0xFFFFFFFF), pack(times[s]), batches.astype("<i8").tobytes()])


@dataclass
class Discounts:
    """Discounted counts of the classes 1..K of words and pairs, and the sizes of the training part."""

    tokens: int
    types: int
    documents: int
    word: np.ndarray
    pair: np.ndarray
    unknown: float


def good_turing(n_of: np.ndarray) -> np.ndarray:
    """Katz's discounted counts of 1..K from the numbers of types seen 1..K+1 times (``n_of[r]``); a count whose estimate is not inside (0, r) loses EPSILON."""
    n_of = n_of.astype(np.float64)
    out = np.arange(1, K + 1) - EPSILON
    rest = (K + 1) * n_of[K + 1] / n_of[1] if n_of[1] else 1.0
    for r in range(1, K + 1):
        if n_of[r] and rest < 1:
            c = ((r + 1) * n_of[r + 1] / n_of[r] / r - rest) / (1 - rest) * r
            if 0 < c < r:
                out[r - 1] = c
    return out


def _weights(d: Discounts, stats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(count, count times backoff weight) of contexts with these successor statistics."""
    n, m = stats[: K + 1], stats[K + 2 : 2 * K + 3]
    count = sum(r * x for r, x in zip(range(1, K + 1), n)) + stats[K + 1]
    used = sum(c * x for c, x in zip(d.pair, n)) + stats[K + 1] - EPSILON * n[K]
    below = (sum(c * x for c, x in zip(d.word, m)) + stats[2 * K + 3] - EPSILON * m[K]) / max(d.tokens, 1)
    return count, np.maximum(count - used, 1e-300) / np.maximum(1 - below, 1e-12)


def _back_off(rows: list, d: Discounts, number_of: int):
    """Per batch the documents' sums of log10(c(v) bow(v)) over the unseen pairs whose contexts lie in this partition."""
    asked = [p for kind, p in rows if kind == _UNSEEN]
    tables = [p for kind, p in rows if kind == _CONTEXTS]
    if not asked or not tables:
        return
    v, stats = _reduced(np.concatenate([unpack_sorted(p[0]) for p in tables]), np.stack([np.concatenate([unpack(p[k]) for p in tables]) for k in range(1, len(tables[0]))]).astype(np.float64))
    value = np.log10(_weights(d, list(stats))[1])
    batch, doc, total = [], [], []
    for p in asked:
        context = unpack_sorted(p[0])
        at = np.minimum(np.searchsorted(v, context), len(v) - 1)
        known = v[at] == context  # a context that training hasn't seen backs off with weight 1
        batch.append(np.frombuffer(p[4], dtype="<i8")[unpack(p[1]).astype(np.int64)][known])
        doc.append(unpack(p[2])[known].astype(np.int64))
        total.append((value[at] * unpack(p[3]))[known])
    batch, doc, total = np.concatenate(batch), np.concatenate(doc), np.concatenate(total)
    order = np.argsort(batch, kind="stable")
    batch, doc, total = batch[order], doc[order], total[order]
    first, _ = _runs(batch)
    for a, b in zip(first, np.append(first[1:], len(batch))):
        docs, sums = _reduced(doc[a:b], total[None, a:b])
        yield (_UNSEEN, number_of, int(batch[a]), [pack_sorted(docs), sums[0].astype("<f8").tobytes()])


def _finish(rows: list, d: Discounts):
    """Rows of one batch's documents."""
    head = next(p for kind, p in rows if kind == _DOCS)
    ids, null, held = np.frombuffer(head[0], dtype="<i8"), np.frombuffer(head[1], dtype=np.uint8) > 0, np.frombuffer(head[2], dtype=np.uint8) > 0
    length = unpack(head[3]).astype(np.int64)
    total = np.zeros((3 + K + K + 2, len(ids)))
    back = np.zeros(len(ids))
    for kind, p in rows:
        if kind == _SUMS:
            sums = np.stack([unpack(x).astype(np.int64) for x in p[1:]])
            sums[2] = sums[2] >> 1 ^ -(sums[2] & 1)
            total[:, unpack_sorted(p[0]).astype(np.int64)] += sums
        elif kind == _UNSEEN:
            back[unpack_sorted(p[0]).astype(np.int64)] += np.frombuffer(p[1], dtype="<f8")
    known, base, fixed = total[0], total[1] / _BASE, total[2] / _SCORE
    log_n = np.log10(max(d.tokens, 1))
    word = np.concatenate([[np.log10(d.unknown)], np.log10(d.word) - log_n, [-log_n]])
    score = fixed + back + np.log10(d.pair) @ total[3 : 3 + K] + word @ total[3 + K :] - (np.log10(d.documents) if d.documents else 0.0)
    base = base - length * np.log10(d.tokens + d.types + 1)
    cols = [pa.array(ids, mask=null), pa.array(held), pa.array(length), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), d.tokens)), pa.array(base), pa.array(score)]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def heavy_words(docs: DataFrame, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(words, their training counts, training documents) of at most 1 / share words, those with a large part of some batch."""

    def frequent(batch: pa.RecordBatch) -> pa.RecordBatch:
        word, _, _ = _tokens(batch.column(1).to_pylist())
        u, n = np.unique(word, return_counts=True)
        keep = n >= max(2, share * len(word))
        return pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(n[keep])], names=["word", "n"])

    found = map_text(docs.select("held_out", "text"), "text", frequent, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = np.sort(np.array([r["word"] for r in found.orderBy(F.desc("n"), "word").limit(int(1 / share)).collect()], dtype=np.int64).view(np.uint64))

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = batch.column(0).to_numpy(zero_copy_only=False)
        word, _, doc = _tokens(batch.column(1).to_pylist())
        word = word[~held[doc]]
        at = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
        n = np.bincount(at[words[at] == word], minlength=len(words)) if len(words) else np.empty(0, dtype=np.int64)
        return pa.RecordBatch.from_arrays([pa.array([*range(len(words)), -1], pa.int32()), pa.array([*n.tolist(), int((~held).sum())], pa.int64())], names=["at", "n"])

    counts = map_text(docs.select("held_out", "text"), "text", exact, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row per heavy word
    by = {r["at"]: r["n"] for r in counts}
    return words, np.array([by.get(k, 0) for k in range(len(words))], dtype=np.int64), by.get(-1, 0)


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all rows of (doc_id, held_out, text); rows that are not held out train."""
    spark, buckets = docs.sparkSession, n_buckets(docs.sparkSession)
    heavy, heavy_count, documents = heavy_words(docs, 1 / (4 * buckets))

    def send(batches):
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                yield _flow(list(_send(part, number, buckets, heavy)))
                number += 1
                tidy()

    def count(batches):
        pairs = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == _DOCS:
                    yield _flow([(r["kind"], r["bucket"], r["batch"], r["parts"])])
                else:
                    pairs.append((r["batch"], r["parts"]))
                    bucket = r["bucket"]
        if pairs:
            for row in _count(pairs, bucket, buckets, heavy, heavy_count):
                yield _flow([row])
        tidy()

    model = stored(gathered(docs.select("doc_id", "held_out", "text").mapInArrow(send, _FLOW), buckets).mapInArrow(count, _FLOW), "katz")
    total = np.zeros(2 + 2 * (K + 2) + 1, dtype=np.int64)
    for r in model.where(F.col("kind") == _COUNTS).select("parts").collect():  # a row per partition
        total += np.frombuffer(r["parts"][0], dtype="<i8")
    big = heavy_count[heavy_count > 0]
    words = total[2 : K + 4] + np.bincount(_class(big), minlength=K + 2)
    words[K + 1] = total[-1] + (big == K + 1).sum()
    tokens = int(total[0] + big.sum())
    d = Discounts(tokens, int(total[1] + len(big)), documents, good_turing(words), good_turing(total[K + 4 : 2 * K + 6]), 1.0)
    if tokens:
        above = int(total[1] + len(big)) - int(words[1 : K + 1].sum())  # types seen more than K times
        low = sum(r * n for r, n in zip(range(1, K + 1), words[1:]))
        d.unknown = float(1 - (d.word @ words[1 : K + 1] + (tokens - low) - EPSILON * above) / tokens)

    def back_off(batches):
        rows, number_of = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                rows.append((r["kind"], r["parts"]))
                number_of = r["bucket"]
        yield from (_flow([x]) for x in _back_off(rows, d, number_of))
        tidy()

    def finish(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                by.setdefault(r["batch"], []).append((r["kind"], r["parts"]))
        for rows in by.values():
            yield _finish(rows, d)

    answers = gathered(model.where(F.col("kind").isin(_CONTEXTS, _UNSEEN)), buckets).mapInArrow(back_off, _FLOW)
    parts = model.where(F.col("kind").isin(_DOCS, _SUMS)).unionByName(answers).repartition(buckets, "batch")
    return parts.mapInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every document under the model of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score_documents(docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text")))
