"""Benchmark decontamination with an FM-index per shard of documents.

Each batch of documents is a shard: its words become symbols, a suffix array
gives the Burrows-Wheeler transform, a wavelet matrix over it answers ranks,
and the test windows are searched backwards, all at once per step.  Their
occurrences are located by walking to sampled suffix positions, and the spans
are merged into hit words.

Only words of the benchmark can be part of an occurrence, so a shard's symbol
sequence holds the maximal runs of such words that are at least as long as the
shortest window; all other words are left out of the index, not of the counts.
This loses nothing and keeps the index small where little is contaminated.
Hashes only propose a word's symbol; its bytes decide, and equal windows are
merged by their symbols, so no result rests on a hash.

The windows go out to the executors in blocks of about ``BLOCK_BYTES`` of
benchmark text; longer items are cut into overlapping pieces.  One block is one
pass and the only one in the driver's memory at that time; hits of several
blocks are written to the shared folder and merged.

Defined cases: null texts have no words; documents without words return zero
counts; items without words match nothing; windows of items without an id mark
hits, such items count as one in n_items and are left out of the digest;
repeated items count once, repeated documents are returned each; ties do not
arise; very long texts are a shard of their own; empty tables give no rows or
no hits; other columns are not read by the query and kept by the stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.llm.common import map_text, private, stored, table
from erlink.llm.textvec import ALNUM, Words, inside_documents, same_words, sequence_hashes, split_words, word_hashes

WINDOW = 10
SAMPLE = 8
BLOCK_BYTES = 16 << 20
#: Longer items are cut into pieces of about this size.
PIECE_BYTES = 1 << 20


@dataclass
class Windows:
    """Distinct test windows as places in one symbol sequence, and the items that each belongs to."""

    words: Words  # one of each word of the vocabulary, in order of their hashes
    hashes: np.ndarray
    seed: int  # of the hashes, chosen so that they tell all these words apart
    symbols: np.ndarray  # of all items one after the other; a word's symbol is its place in the vocabulary + 1
    end: np.ndarray  # where each window ends in ``symbols``
    length: np.ndarray
    item_first: np.ndarray  # windows + 1 offsets into item_of
    item_of: np.ndarray  # indexes into item_ids
    item_ids: list[str | None]
    shortest: int


def _vocabulary(w: Words) -> tuple[Words, np.ndarray, int, np.ndarray]:
    """(distinct words, their ascending hashes, the hashes' seed, the place of each word among them)."""
    seed = 0
    while True:
        hashes, first, place = np.unique(word_hashes(w, seed), return_index=True, return_inverse=True)
        if same_words(w, np.arange(len(place)), w, first[place]).all():
            return Words(w.data, w.start[first], w.end[first], w.doc[first], w.first, w.edge), hashes, seed, place
        seed += 1


def build_windows(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> Windows:
    ids: list[str | None] = sorted({i for i, _ in items if i is not None})
    place = {i: k for k, i in enumerate(ids)}
    if any(i is None for i, _ in items):
        place[None] = len(ids)
        ids.append(None)
    item = np.array([place[i] for i, _ in items], dtype=np.int64)
    w = split_words([t for _, t in items], ALNUM, lower=True)
    words, hashes, seed, at = _vocabulary(w)
    symbols = at.astype(np.int32) + 1
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < size))
    full = inside_documents(w, size)
    start = np.concatenate([w.first[short], full]).astype(np.int64)
    length = np.concatenate([count[short], np.full(len(full), size)]).astype(np.int64)
    owner = item[w.doc[start]] if len(start) else np.empty(0, dtype=np.int64)
    # windows of one length and hash stand together; each is merged with the first there if their symbols agree
    code = np.concatenate([np.zeros(len(short), dtype=np.uint64), sequence_hashes(symbols.astype(np.uint64), size)[full] if len(full) else np.empty(0, dtype=np.uint64)])
    order = np.lexsort((start, code, length))
    start, length, owner, code = start[order], length[order], owner[order], code[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (length[1:] != length[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.empty(0, dtype=np.int64)
    alike = np.ones(len(start), dtype=bool)
    for k in range(size):
        there = k < length
        alike &= ~there | (symbols[np.where(there, start + k, 0)] == symbols[np.where(there, start[lead] + k, 0)]) if len(symbols) else True
    new |= ~alike  # a window that only shares the hash stands for itself
    group = np.where(alike, (np.cumsum(new) - 1)[lead], np.cumsum(new) - 1) if len(new) else np.empty(0, dtype=np.int64)
    pairs = np.unique(group * len(ids) + owner)
    first = np.searchsorted(pairs // max(len(ids), 1), np.arange(int(new.sum()) + 1))
    return Windows(words, hashes, seed, symbols, (start + length)[new], length[new], first, pairs % max(len(ids), 1), ids, int(length.min(initial=size)))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence whose last symbol is its single smallest, by prefix doubling."""
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], np.diff(s[order]) != 0]))
    step = 1
    while rank[order[-1]] < len(s) - 1:
        nxt = np.zeros(len(s), dtype=np.int64)
        nxt[:-step] = rank[step:] + 1
        key = rank * (len(s) + 1) + nxt
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        step *= 2
    return order


class WaveletMatrix:
    """Ranks and symbols of a sequence, bit plane by bit plane."""

    def __init__(self, sequence: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.zeros_before, self.zeros = [], []
        s = sequence
        for b in reversed(range(self.bits)):
            one = (s >> b & 1).astype(bool)
            self.zeros_before.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            self.zeros.append(int(self.zeros_before[-1][-1]))
            s = np.concatenate([s[~one], s[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(at)
        for k, b in enumerate(reversed(range(self.bits))):
            z, one = self.zeros_before[k], (symbol >> b & 1).astype(bool)
            at, low = (np.where(one, self.zeros[k] + x - z[x], z[x]) for x in (at, low))
        return at - low

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        low, symbol = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.bits):
            z = self.zeros_before[k]
            one = z[at + 1] == z[at]
            symbol = symbol << 1 | one
            at, low = (np.where(one, self.zeros[k] + x - z[x], z[x]) for x in (at, low))
        return symbol, at - low


class FMIndex:
    """Index of a sequence of symbols >= 1 with 0 between its segments (and at both ends)."""

    def __init__(self, s: np.ndarray, largest: int):
        breaks = np.flatnonzero(s == 0)
        ordered = s.astype(np.int64) + len(breaks)
        ordered[breaks] = np.arange(len(breaks))[::-1]  # each break is a symbol of its own for sorting, the last the smallest
        suffix = suffix_array(ordered)
        before = s[suffix - 1]  # the suffix at 0 starts with a break and wraps to one
        self.matrix = WaveletMatrix(before, largest)
        count = np.bincount(s, minlength=largest + 2)
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        # walks stop at every SAMPLE-th position and where a segment begins, so they never cross a break
        sampled = (suffix % SAMPLE == 0) | (before == 0)
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.sample = suffix[sampled]

    def search(self, symbols: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of all patterns, the ``length`` symbols before each ``end``."""
        last = symbols[end - 1].astype(np.int64)
        low, high = self.first[last], self.first[last + 1]
        for k in range(2, int(length.max(initial=0)) + 1):
            go = np.flatnonzero((length >= k) & (low < high))
            if not len(go):
                break
            c = symbols[end[go] - k].astype(np.int64)
            low[go] = self.first[c] + self.matrix.rank(c, low[go])
            high[go] = self.first[c] + self.matrix.rank(c, high[go])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these rows."""
        row, steps, out = row.copy(), 0, np.empty(len(row), dtype=np.int64)
        todo = np.arange(len(row))
        while len(todo):
            here = self.sampled[row[todo]]
            found = todo[here]
            out[found] = self.sample[self.sample_rank[row[found]]] + steps
            todo = todo[~here]
            if len(todo):
                c, r = self.matrix.symbol_and_rank(row[todo])
                row[todo] = self.first[c] + r
            steps += 1
        return out


def find(texts, win: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(words, hit flag of each word, first word of each text, indexes of each text's items)."""
    w = split_words(texts, ALNUM, lower=True)
    n, total = len(w.first) - 1, len(w.start)
    none = [np.empty(0, dtype=np.int64)] * n
    flags = np.zeros(total, dtype=bool)
    if not total or not len(win.length):
        return np.diff(w.first), flags, w.first, none
    h = word_hashes(w, win.seed)
    at = np.minimum(np.searchsorted(win.hashes, h), len(win.hashes) - 1)
    known = win.hashes[at] == h
    maybe = np.flatnonzero(known)
    known[maybe] = same_words(w, maybe, win.words, at[maybe])
    symbol = np.where(known, at + 1, 0).astype(np.int32)
    starts_run = known & np.concatenate([[True], ~known[:-1] | (w.doc[1:] != w.doc[:-1])])
    run = np.cumsum(starts_run) - 1
    size = np.bincount(run[known], minlength=max(1, int(run[-1]) + 1))
    keep = np.flatnonzero(known & (size[np.maximum(run, 0)] >= win.shortest))
    if not len(keep):
        return np.diff(w.first), flags, w.first, none
    # the kept runs with a break before each and one at the end
    new = starts_run[keep]
    place = np.arange(len(keep)) + np.cumsum(new)
    s = np.zeros(len(keep) + int(new.sum()) + 1, dtype=np.int32)
    s[place] = symbol[keep]
    word_at = np.full(len(s), -1, dtype=np.int64)
    word_at[place] = keep
    index = FMIndex(s, len(win.hashes))
    low, high = index.search(win.symbols, win.end, win.length)
    found = np.flatnonzero(high > low)
    if not len(found):
        return np.diff(w.first), flags, w.first, none
    times = (high - low)[found]
    which = np.repeat(found, times)
    rows = np.repeat(low[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    word = word_at[index.locate(rows)]
    change = np.zeros(total + 1, dtype=np.int64)
    np.add.at(change, word, 1)
    np.add.at(change, word + win.length[which], -1)
    flags = np.cumsum(change)[:total] > 0
    pairs = np.unique(w.doc[word].astype(np.int64) * len(win.length) + which)
    doc, which = pairs // len(win.length), pairs % len(win.length)
    many = np.diff(win.item_first)[which]
    of = win.item_of[np.repeat(win.item_first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    pairs = np.unique(np.repeat(doc, many) * len(win.item_ids) + of)
    doc, of = pairs // len(win.item_ids), pairs % len(win.item_ids)
    cut = np.searchsorted(doc, np.arange(n + 1))
    return np.diff(w.first), flags, w.first, [of[a:b] for a, b in zip(cut, cut[1:])]


def _pieces(items: DataFrame, size: int = WINDOW, limit: int = PIECE_BYTES) -> DataFrame:
    """(item_id, piece, text): long texts cut between words into pieces that overlap by ``size`` - 1 words, so that their windows are the item's."""

    def cut(text: str | None) -> list[str | None]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) <= limit:
            return [text]
        w = split_words([raw], ALNUM, lower=True)
        step = max(size, len(w.start) * limit // len(raw))
        if step >= len(w.start):
            return [text]
        return [raw[w.start[a] : w.end[min(a + step + size - 1, len(w.start)) - 1]].decode("utf-8", "surrogatepass") for a in range(0, len(w.start) - size + 1, step)]

    def run(batches):
        for batch in batches:
            rows = [(item, k, part) for item, text in zip(*(batch.column(c).to_pylist() for c in (0, 1))) for k, part in enumerate(cut(text))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["item_id", "piece", "text"])

    return items.mapInArrow(run, "item_id string, piece bigint, text string")


def benchmark_blocks(benchmark: DataFrame, limit: int | None = None) -> Iterator[Windows]:
    """The windows of all items, block by block; texts of a block have about ``limit`` (else ``BLOCK_BYTES``) bytes."""
    pieces = _pieces(benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")))
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(1, -(-size // (limit or BLOCK_BYTES)))
    for k in range(n):
        part = pieces.where(F.pmod(F.xxhash64("item_id", "piece"), F.lit(n)) == k) if n > 1 else pieces
        got = part.toArrow()
        yield build_windows(list(zip(got.column("item_id").to_pylist(), got.column("text").to_pylist())))


def _digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(i for i in ids if i is not None)).encode()).hexdigest()


_OUT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def contamination(docs: DataFrame, benchmark: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per document row: counts of words, hit words and items."""
    blocks = benchmark_blocks(benchmark, limit)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        held = docs.sparkSession.sparkContext.broadcast(first)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            win = held.value
            n, flags, first, items = find(batch.column(1).to_pylist(), win)
            hit = np.diff(np.concatenate([[0], np.cumsum(flags)])[first])
            ids = [[win.item_ids[k] for k in x] for x in items]
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([_digest(x) for x in ids], pa.string()), pa.array(hit > 0)]
            return pa.RecordBatch.from_arrays(cols, names=_NAMES)

        return map_text(docs.select("doc_id", "text"), "text", run, _OUT)
    found = _hits(docs, chain([first, second], blocks))

    def merge(batches):
        for batch in batches:
            ids, words = batch.column(0), batch.column(1)
            hits = [_union(x) for x in batch.column(2).to_pylist()]
            items = [set().union(*(x or [])) for x in batch.column(3).to_pylist()]
            cols = [ids, words, *(pa.array(c, t) for c, t in zip(([len(h) for h in hits], [len(i) for i in items], [_digest(i) for i in items], [len(h) > 0 for h in hits]), _TYPES[2:]))]
            yield pa.RecordBatch.from_arrays(cols, names=_NAMES)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.diff(split_words(batch.column(2).to_pylist(), ALNUM, lower=True).first)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "hash", "n_words"])

    counted = map_text(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"), "text", count, "doc_id bigint, hash bigint, n_words bigint")
    f = found.withColumnsRenamed({"doc_id": "id", "hash": "of"})
    rows = counted.join(f, counted["doc_id"].eqNullSafe(f["id"]) & (counted["hash"] == f["of"]), "left")
    return rows.select("doc_id", "n_words", "hits", "items").mapInArrow(merge, _OUT)


def _union(hits: list[bytes] | None) -> np.ndarray:
    return np.unique(np.concatenate([np.frombuffer(h, dtype="<i8") for h in hits])) if hits else np.empty(0, dtype=np.int64)


def _hits(docs: DataFrame, blocks) -> DataFrame:
    """(doc_id, hash, hits, items) of the documents that some block hits, with a list entry per block; equal rows have equal hits."""
    parts = None
    for win in blocks:  # a pass each; the block before is given up first
        held = docs.sparkSession.sparkContext.broadcast(win)

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            win = held.value
            _, flags, first, items = find(batch.column(2).to_pylist(), win)
            hits = [np.flatnonzero(flags[a:b]).astype("<i8").tobytes() for a, b in zip(first, first[1:])]
            cols = [batch.column(0), batch.column(1), pa.array(hits, pa.binary()), pa.array([[win.item_ids[k] for k in x] for x in items], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "hash", "hits", "items"]).filter(pa.array([len(h) > 0 for h in hits], pa.bool_()))

        rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
        part = stored(map_text(rows, "text", run, "doc_id bigint, hash bigint, hits binary, items array<string>").distinct(), "hits")
        held.destroy()
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("doc_id", "hash").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))


def op2_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside an occurrence of a benchmark window."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def remove_spans(text: str | None, flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> str | None:
    """The text without its hit words; each removed span takes the bytes up to the next kept word with it."""
    if not flags.any():
        return text
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    for a, b in zip(edge[0::2], edge[1::2]):
        out.append(raw[at : start[a]])
        at = int(start[b]) if b < len(start) else int(end[b - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, limit: int | None = None) -> DataFrame:
    """Pipeline stage: hit words are cut from the texts; documents of which nothing is left go.

    n_chars becomes the new text's length where a text is cut.  Null and empty
    texts, repeated rows and null doc_ids stay as they are; without benchmark
    items every row stays; empty docs give no rows; all columns are kept.
    """
    blocks = benchmark_blocks(table(spark, sf_dir, "benchmark"), limit)
    one, second = next(blocks), next(blocks, None)
    schema = docs.schema

    def cut(batch: pa.RecordBatch, flags: np.ndarray) -> pa.RecordBatch:
        """The batch's rows (the columns of ``docs`` come first) without the flagged words."""
        names = schema.names
        at = names.index("text")
        texts = batch.column(at).to_pylist()
        w = split_words(texts, ALNUM, lower=True)
        new, keep = [], []
        for d, t in enumerate(texts):
            a, b = w.first[d], w.first[d + 1]
            hit = flags[a:b]
            new.append(remove_spans(t, hit, w.start[a:b] - w.edge[d], w.end[a:b] - w.edge[d]) if hit.any() else t)
            keep.append(not (hit.any() and hit.all()))
        cols = [batch.column(i) for i in range(len(names))]
        cols[at] = pa.array(new, batch.schema.field(at).type)
        if "n_chars" in names:
            i = names.index("n_chars")
            cols[i] = pa.array([len(n) if n is not t else o for n, t, o in zip(new, texts, batch.column(i).to_pylist())], batch.schema.field(i).type)
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    if second is None:
        held = spark.sparkContext.broadcast(one)
        return map_text(docs, "text", lambda batch: cut(batch, find(batch.column(schema.names.index("text")).to_pylist(), held.value)[1]), schema)
    of, ident, hits = private(docs, "of", "id", "hits")
    found = _hits(docs, chain([one, second], blocks)).select(F.col("doc_id").alias(ident), F.col("hash").alias(of), F.col("hits").alias(hits))
    rows = docs.join(found, docs["doc_id"].eqNullSafe(found[ident]) & (F.xxhash64(docs["text"]) == found[of]), "left").drop(ident, of)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = split_words(batch.column(schema.names.index("text")).to_pylist(), ALNUM, lower=True)
        flags = np.zeros(len(w.start), dtype=bool)
        for first, h in zip(w.first, batch.column(batch.num_columns - 1).to_pylist()):
            flags[first + _union(h)] = True
        return cut(batch, flags)

    return map_text(rows, "text", run, schema)
