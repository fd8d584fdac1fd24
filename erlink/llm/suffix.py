"""Substring dedup: suffixes cut at ``WINDOW`` words, partitioned by prefixes of their codes.

The deep internal nodes of a suffix tree that matter here are those at depth
``WINDOW`` words: two suffixes pass through the same one exactly if their first
``WINDOW`` words are equal.  A suffix is coded by a 64-bit fingerprint of those
words; codes are split by their leading bits into memory-sized groups, and each
group is sorted, so that equal codes (the leaves below one deep node) stand
together and the earliest start among them is known.  Every other start is a
repeat whose words go.

A batch of documents resolves its own repeats and sends only the first start of
each of its windows, so a passage that a third of all documents share costs one
entry per batch.  Groups answer to the batches with the starts that are
repeats elsewhere; each batch then knows its documents' removed words.

Defined cases: null texts have no words; texts of fewer than ``WINDOW`` words
lose nothing; rows that share a doc_id are one document, so equal windows at
the same start of it are not earlier than each other and repeated rows get
equal results; null doc_ids count as one document before all others; very long
texts are a batch of their own; an empty table gives no rows; other columns
are not read by the query and kept by the stage.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erlink.llm.common import gathered, map_text, n_buckets, pack, pack_sorted, private, slices, table, tidy, unpack, unpack_sorted
from erlink.llm.textvec import NON_SPACE, inside_documents, sequence_hashes, split_words, word_hashes

WINDOW = 20
#: Text bytes of a batch; larger batches send fewer and better packed entries.
BATCH_BYTES = 12 << 20
_FLOW = "bucket int, batch bigint, codes binary, doc binary, start binary, ids binary, hashes binary"
_NAMES = ["bucket", "batch", "codes", "doc", "start", "ids", "hashes"]
_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
_NULL_ID = np.iinfo(np.int64).min


def _flow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Leading bits of a code scaled to the number of buckets; ascending in the code."""
    return ((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _earliest(codes: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by code, id and start; whether each row there has an earlier one of the same code)."""
    order = np.lexsort((start, ids, codes))
    c, i, s = codes[order], ids[order], start[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, dtype=np.int64)
    lead = np.repeat(first, np.diff(np.append(first, len(c))))
    return order, (i != i[lead]) | (s != s[lead])


def _send(batch: pa.RecordBatch, number: int, buckets: int, window: int):
    """What a batch sends: a part of its windows' codes to each group, and to itself its documents and own repeats."""
    texts = batch.column(2).to_pylist()
    ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
    hashes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    w = split_words(texts, NON_SPACE, lower=False)
    at = inside_documents(w, window)
    codes = sequence_hashes(word_hashes(w), window)[at]
    doc = w.doc[at]
    start = at - w.first[doc]
    order, repeat = _earliest(codes, ids[doc], start)
    own = order[repeat]
    yield (number % buckets, number, None, pack(doc[own]), pack(start[own]), ids.astype("<i8").tobytes(), hashes.astype("<i8").tobytes())
    order = order[~repeat]
    codes, doc, start = codes[order], doc[order], start[order]
    cut = np.searchsorted(_bucket_of(codes, buckets), np.arange(buckets + 1))
    for k in range(buckets):
        a, b = cut[k], cut[k + 1]
        if a < b:
            used, local = np.unique(doc[a:b], return_inverse=True)
            yield (k, number, pack_sorted(codes[a:b]), pack_sorted(used), pack(start[a:b]), pack(local), ids[used].astype("<i8").tobytes())


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, hash, starts): packed starts of the repeated windows of each document that has some; hash is xxhash64 of the text."""
    buckets = n_buckets(docs.sparkSession)

    def send(batches):
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                yield _flow(list(_send(part, number, buckets, window)))
                number += 1
        tidy()

    def group(batches):
        parts = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["codes"] is None:
                    yield _flow([tuple(r[n] for n in _NAMES)])
                else:
                    parts.append(r)
        if not parts:
            return
        codes = [unpack_sorted(r["codes"]) for r in parts]
        size = np.array([len(c) for c in codes])
        local = [unpack(r["ids"]).astype(np.int64) for r in parts]
        ids = np.concatenate([np.frombuffer(r["hashes"], dtype="<i8")[x] for r, x in zip(parts, local)])
        start = np.concatenate([unpack(r["start"]).astype(np.int32) for r in parts])
        order, repeat = _earliest(np.concatenate(codes), ids, start)
        flags = np.zeros(len(order), dtype=bool)
        flags[order[repeat]] = True
        for r, x, a, b in zip(parts, local, np.cumsum(size) - size, np.cumsum(size)):
            if (hit := flags[a:b]).any():
                doc = unpack_sorted(r["doc"]).astype(np.int64)[x[hit]]
                yield _flow([(r["bucket"], r["batch"], None, pack(doc), pack(start[a:b][hit]), None, None)])
        tidy()

    def answer(batches):
        by: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                by.setdefault(r["batch"], []).append(r)
        for rows in by.values():
            head = next(r for r in rows if r["ids"] is not None)
            ids, hashes = np.frombuffer(head["ids"], dtype="<i8"), np.frombuffer(head["hashes"], dtype="<i8")
            key = np.sort(np.concatenate([unpack(r["doc"]) << np.uint64(32) | unpack(r["start"]) for r in rows]))
            doc = (key >> np.uint64(32)).astype(np.int64)
            has = np.unique(doc)
            cut = np.searchsorted(doc, np.append(has, np.iinfo(np.int64).max))
            starts = [pack_sorted(key[a:b] & np.uint64(0xFFFFFFFF)) for a, b in zip(cut, cut[1:])]
            id_col = pa.array(ids[has], mask=ids[has] == _NULL_ID)
            yield pa.RecordBatch.from_arrays([id_col, pa.array(hashes[has]), pa.array(starts, pa.binary())], names=["doc_id", "hash", "starts"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    sent = gathered(rows.mapInArrow(send, _FLOW), buckets).mapInArrow(group, _FLOW)
    found = sent.repartition(buckets, "batch").mapInArrow(answer, "doc_id bigint, hash bigint, starts binary")
    # repeated rows of one document have equal starts
    return found.groupBy("doc_id", "hash").agg(F.min("starts").alias("starts"))


def covered(n_words: int, starts: bytes | None, window: int = WINDOW) -> np.ndarray:
    """Flags of the words that a removed window covers."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    if starts is not None:
        s = unpack_sorted(starts).astype(np.int64)
        np.add.at(change, s, 1)
        np.add.at(change, s + window, -1)
    return np.cumsum(change)[:-1] > 0


def with_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows of ``docs`` and, as the last column, the packed starts (null where nothing repeats)."""
    ident, of, starts = private(docs, "id", "of", "starts")
    found = repeats(docs, window).withColumnsRenamed({"doc_id": ident, "hash": of, "starts": starts})
    on = docs["doc_id"].eqNullSafe(F.col(ident)) & (F.xxhash64(docs["text"]) == F.col(of))
    return docs.join(found, on, "left").drop(ident, of)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows repeated from earlier cover are removed; digest of the kept words."""
    rows = with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, digest = [], [], []
        for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            n.append(len(words))
            if s is None:
                removed.append(0)
            else:
                gone = covered(len(words), s)
                removed.append(int(gone.sum()))
                words = [x for x, g in zip(words, gone.tolist()) if not g]
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_text(rows, "text", run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are cut from the texts; documents of which nothing is left go.

    n_chars becomes the new text's length where a text is cut.  Null, empty and
    short texts stay as they are, rows of one doc_id (or without one) are one
    document, so repeated rows are cut alike; empty docs give no rows; all
    columns are kept.
    """
    from erlink.llm.fmindex import remove_spans

    schema = docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = schema.names
        at = batch.schema.names.index("text")
        texts, starts = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        new, keep = list(texts), [True] * len(texts)
        for k, (t, s) in enumerate(zip(texts, starts)):
            if s is not None:
                w = split_words([t], NON_SPACE, lower=False)
                gone = covered(len(w.start), s)
                new[k], keep[k] = remove_spans(t, gone, w.start, w.end), not gone.all()
        cols = [batch.column(i) for i in range(len(names))]
        cols[at] = pa.array(new, batch.schema.field(at).type)
        if "n_chars" in names:
            i = names.index("n_chars")
            cols[i] = pa.array([len(x) if s is not None else o for x, s, o in zip(new, starts, batch.column(i).to_pylist())], batch.schema.field(i).type)
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return map_text(with_repeats(docs), "text", run, schema)
