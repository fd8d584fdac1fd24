"""Near-duplicate groups at a Jaccard similarity of word shingles, found by SimHash and verified exactly.

The general form of the segment-popcount embedding: fingerprints are ``LANES``
words of 64 bits, cut into 2-bit segments whose bit counts are the embedding.
Each grid is a choice of ``S`` segments; texts with equal counts there share a
cell, and in a cell the Manhattan distance of the embeddings and the distance
of the fingerprints are held against ``RADIUS``.  That is wide enough for a
similarity of 0.8, where two of 128 bits in thirteen differ; unrelated texts
differ in half of them.  ``S`` follows the number of texts, so that a cell holds
a bounded number of unrelated ones, and the number of grids follows ``S``, so
that recall does not fall with size (``grids``).

Links only propose: the texts of each connected group of links are gathered and
compared on their whole shingle sets, each text with all that are not yet
reached, so the groups returned are exactly the connected texts of similarity
``SIMILARITY`` or more inside each proposed group.  Proposed groups beyond
``CHUNK`` texts are cut, and each pair of cuts is a group of its own.

Texts of one shingle set are one node, whatever their number.  Of what has to
meet its text again (shingle sets, chosen rows) a bitmap of fixed size, built
from row keys, lets only a few other rows through to the join.

Defined cases: null text counts as empty; texts without words are copies of each
other, texts of fewer than five words have their whole sequence as one shingle;
repeated rows, and rows with a null doc_id, are rows like others; of equal
doc_ids the row of the smallest key stays; an empty table gives no rows; all
columns stay, whatever their names and types.  Two of n texts share a node or a
row key by chance with about n * n / 2**65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erlink.llm.common import map_text, n_buckets, pack_sorted, private, stored, tidy, unpack_sorted
from erlink.llm.components import components, spanning
from erlink.llm.textvec import NON_SPACE, inside_documents, mix, sequence_hashes, split_words, word_hashes

SHINGLE = 5
#: Similarity as a fraction: shared / all >= 4 / 5.
SIMILARITY = (4, 5)
LANES = 2
RADIUS = 30
#: Texts of a proposed group that are compared in one task, and of a pair of cuts at most twice as many.
CHUNK = 1024
#: Unrelated texts in a cell, at most about.
FILL = 64
#: Bits of the bitmap of row keys.
MARK_BITS = 22
#: Text bytes that are cut into shingles at once.
PART = 1 << 20
_FIVE = np.uint64(0x5555555555555555)


def shingle_sets(texts, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text (A-Z lower-cased); fewer words: the whole sequence; none: empty."""
    w = split_words(texts, NON_SPACE, lower=True)
    h = word_hashes(w)
    at = inside_documents(w, shingle)
    codes, doc = sequence_hashes(h, shingle)[at], w.doc[at]
    cut = np.searchsorted(doc, np.arange(len(w.first)))
    out = []
    for d in range(len(w.first) - 1):
        a, b = w.first[d], w.first[d + 1]
        out.append(np.unique(codes[cut[d] : cut[d + 1]]) if b - a >= shingle else sequence_hashes(h[a:b], int(b - a)) if b > a else np.empty(0, dtype=np.uint64))
    return out


def majority(codes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """The fingerprint of a shingle set: bits that more than half of its hashes set, per lane."""
    out = np.zeros(lanes, dtype=np.uint64)
    for lane in range(lanes):
        ones = np.zeros(64, dtype=np.int64)
        for k in range(0, len(codes), 1 << 13):
            part = mix(codes[k : k + (1 << 13)] * np.uint64(2 * lane + 3) + np.uint64(lane))
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * ones > len(codes), bitorder="little").view("<u8")[0]
    return out


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 2-bit segments, each in two bits of the result."""
    return (fp & _FIVE) + ((fp >> np.uint64(1)) & _FIVE)


def grids(n: int) -> list[np.ndarray]:
    """Masks (one word per lane) of the segments of each grid for ``n`` texts."""
    size = max(8, int(np.ceil((np.log2(max(n, 1)) - np.log2(FILL)) / 1.45)))  # a segment's count has 1.5 bits
    number = int(np.ceil(64 * 1.33 ** (size - 9)))
    rng, out = np.random.default_rng(1), []
    for _ in range(number):
        mask = np.zeros(LANES, dtype=np.uint64)
        for s in rng.permutation(32 * LANES)[: min(size, 32 * LANES)].tolist():
            mask[s // 32] |= np.uint64(3 << 2 * (s % 32))
        out.append(mask)
    return out


def cells(fp: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """(grids, rows) keys of the cells; ``fp`` is (rows, lanes)."""
    e, out = embed(fp), np.empty((len(masks), len(fp)), dtype=np.uint64)
    for k, mask in enumerate(masks):
        key = np.full(len(fp), k + 1, dtype=np.uint64)
        for lane in range(fp.shape[1]):
            key = mix(key + (e[:, lane] & mask[lane]))
        out[k] = key
    return out


def _unary(x: np.ndarray) -> np.ndarray:
    low, high = x & _FIVE, (x >> np.uint64(1)) & _FIVE
    return (low | high) | (high << np.uint64(1))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(x ^ y).astype(np.int16) for x, y in zip(a.T, b.T))


def near(fp: np.ndarray, counts: np.ndarray, i, j: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether rows ``i`` (one or as many) and ``j`` are within the radius: the Manhattan bound on their counts in unary first, the distance itself on what is left."""
    ok = _distance(counts[i], counts[j]) <= radius
    at = np.flatnonzero(ok)
    ok[at] = _distance(fp[i if i.shape[0] == 1 else i[at]], fp[j[at]]) <= radius
    return ok


def cell_links(key: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, node) that span the near members of each cell: each member against those not yet reached."""
    order = np.argsort(key, kind="stable")
    key, node, fp = key[order], node[order], fp[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, dtype=np.int64)
    size = np.diff(edge)
    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    counts = _unary(embed(fp))
    small = np.flatnonzero(np.repeat((size > 1) & (size <= FILL), size))
    k = key[small]
    for step in range(1, FILL):  # pairs of rows that are `step` apart
        at = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else np.empty(0, dtype=np.int64)
        if not len(at):
            break
        for c in range(0, len(at), 1 << 18):
            i, j = small[at[c : c + (1 << 18)]], small[at[c : c + (1 << 18)] + step]
            ok = near(fp, counts, i, j, radius) if len(i) > 1 else _distance(fp[i], fp[j]) <= radius
            left.append(node[i[ok]])
            right.append(node[j[ok]])
    for c in np.flatnonzero(size > FILL):
        rest = np.arange(edge[c], edge[c + 1])
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                ok = near(fp, counts, np.array([x]), rest, radius)
                left.append(np.full(int(ok.sum()), node[x]))
                right.append(node[rest[ok]])
                queue += rest[ok].tolist()
                rest = rest[~ok]
    return spanning(np.concatenate(left), np.concatenate(right))


def jaccard_links(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of places that span the connected sets: each set is compared with all that are not yet reached.

    Shared shingles are counted over the lists of sets of each shingle or over
    the sets not yet reached, whichever is shorter.
    """
    top, bottom = similarity
    length = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32) if length.sum() else np.empty(0, dtype=np.int32)
    cut = np.concatenate([[0], np.cumsum(length)])
    kinds = int(flat.max(initial=-1)) + 1
    of = np.repeat(np.arange(len(sets), dtype=np.int32), length)[np.argsort(flat, kind="stable")]  # the sets of each shingle
    times = np.bincount(flat, minlength=kinds)
    first = np.cumsum(times) - times
    seen = np.zeros(kinds, dtype=bool)
    out, rest, codes = [], np.arange(len(sets)), flat
    while len(rest):
        x, codes, rest = int(rest[0]), codes[length[rest[0]] :], rest[1:]
        queue = [x]
        while queue and len(rest):
            x = queue.pop()
            own = flat[cut[x] : cut[x + 1]]
            many = times[own]
            if many.sum() < len(codes):
                at = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                both = np.bincount(of[at], minlength=len(sets))[rest]
            else:
                seen[own] = True
                total = np.concatenate([[0], np.cumsum(seen[codes], dtype=np.int32)])
                edge = np.concatenate([[0], np.cumsum(length[rest])])
                both = total[edge[1:]] - total[edge[:-1]]
                seen[own] = False
            ok = both * (top + bottom) >= top * (length[rest] + len(own))  # both / all >= top / bottom
            if ok.any():
                out += [(x, int(y)) for y in rest[ok]]
                queue += rest[ok].tolist()
                codes, rest = codes[np.repeat(~ok, length[rest])], rest[~ok]
    return out


def row_key(df: DataFrame):
    """A 64-bit key of a row's whole content, whatever its columns' types."""

    def has_map(t) -> bool:
        if isinstance(t, T.ArrayType):
            return has_map(t.elementType)
        if isinstance(t, T.StructType):
            return any(has_map(f.dataType) for f in t.fields)
        return not isinstance(t, T.AtomicType) or isinstance(t, T.VariantType)

    at = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields]
    return F.xxhash64(*(F.to_json(F.struct(c.alias("c"))) if has_map(f.dataType) else c for c, f in zip(at, df.schema.fields)))


def with_mark(docs: DataFrame, key, keys: DataFrame, name: str, bits: int = MARK_BITS) -> DataFrame:
    """``docs`` and a column ``name``: whether a bitmap holds the row's ``key``, true for all ``keys`` (column key) and for few other rows.

    The bitmap goes out as 2**bits / 64 words at most, whatever the number of keys.
    """
    place = lambda k: F.shiftrightunsigned(k, 64 - bits)
    word, of, held, at = private(docs, "word", "of", "bits", "at")
    words = keys.select(place(F.col("key")).alias("at")).select(F.shiftright("at", 6).alias(of), F.expr("shiftleft(1L, int(at & 63))").alias("bit"))
    words = words.groupBy(of).agg(F.bit_or("bit").alias(held))
    out = docs.withColumn(at, place(key)).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(words), F.col(word) == F.col(of), "left")  # bounded by the bits
    return out.withColumn(name, F.coalesce(F.expr(f"(shiftrightunsigned(`{held}`, int(`{at}` & 63)) & 1L) = 1L"), F.lit(False))).drop(word, of, held, at)


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, node, f0, ...) of every row: its row key, its shingle set's hash and the set's fingerprint."""
    lanes = [f"f{k}" for k in range(LANES)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2).to_pylist())
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        fp = np.array([majority(s) for s in sets], dtype=np.uint64).reshape(-1, LANES).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), *(pa.array(fp[:, k]) for k in range(LANES))], names=["doc_id", "key", "node", *lanes])

    return map_text(docs.select("doc_id", row_key(docs).alias("key"), "text"), "text", run, "doc_id bigint, key bigint, node bigint, " + ", ".join(f"{c} bigint" for c in lanes), PART)


def proposed(nodes: DataFrame) -> DataFrame:
    """Links (u, v) of nodes within the radius in some cell; ``nodes`` is (node, f0, ...)."""
    spark = nodes.sparkSession
    masks = grids(nodes.count())
    names = ["cell", *nodes.columns]

    def deal(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 10_000):
                part = [c.to_numpy() for c in batch.slice(k, 10_000).columns]
                key = cells(np.stack(part[1:], axis=1).view(np.uint64), masks)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *(pa.array(np.tile(c, len(masks))) for c in part)], names=names)

    def links(batches):
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        if parts:
            key, node, *fp = (np.concatenate(c) for c in zip(*parts))
            u, v = cell_links(key, node, np.stack(fp, axis=1).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        tidy()

    dealt = nodes.mapInArrow(deal, ", ".join(f"{c} bigint" for c in names))
    return dealt.repartition(2 * n_buckets(spark), "cell").mapInArrow(links, "u bigint, v bigint")


def verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links (u, v) of similarity ``SIMILARITY`` or more that span each group; ``members`` is (node, component, doc_id, key) with one row of ``docs`` per node."""
    spark = docs.sparkSession

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        blobs = [pack_sorted(s) for s in shingle_sets(batch.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["doc_id", "key", "set"])

    rows = docs.select("doc_id", row_key(docs).alias("key"), "text")
    few = with_mark(rows, F.col("key"), members.select("key"), "maybe").where("maybe").select("doc_id", "key", "text")
    few = map_text(few, "text", sets, "doc_id bigint, key bigint, set binary", PART).dropDuplicates(["doc_id", "key"])
    size = members.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("cuts"))
    members = members.withColumnsRenamed({"doc_id": "id", "key": "row"})
    found = few.join(members, few["doc_id"].eqNullSafe(members["id"]) & (few["key"] == members["row"])).select("node", "component", "set").join(size, "component")
    cut = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda x: F.least(x, cut) * F.col("cuts") + F.greatest(x, cut))
    dealt = found.withColumn("part", F.explode(pairs)).select("component", "part", "node", "set")
    dealt = dealt.repartition(2 * n_buckets(spark), "component", "part").sortWithinPartitions("component", "part", "node")

    def compare(batches):
        now, nodes, codes = None, [], []

        def links() -> pa.RecordBatch:
            pairs = jaccard_links(codes)
            return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in pairs], pa.int64()), pa.array([nodes[b] for _, b in pairs], pa.int64())], names=["u", "v"])

        for batch in batches:
            for component, part, node, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (component, part) != now:
                    if len(nodes) > 1:
                        yield links()
                    now, nodes, codes = (component, part), [], []
                nodes.append(node)
                codes.append(unpack_sorted(blob))
        if len(nodes) > 1:
            yield links()

    return dealt.mapInArrow(compare, "u bigint, v bigint")


def kept_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of the smallest doc_id (rows without one last), then of the smallest row key."""
    rows = stored(prints(docs), "prints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")
    nodes = stored(rows.groupBy("node", *rows.columns[3:]).agg(F.min(rank).alias("least"), F.count("*").alias("rows")), "nodes")
    group = components(proposed(nodes.select("node", *rows.columns[3:])))
    own = F.when(~F.col("least.none"), F.col("least.id"))
    members = stored(nodes.join(group, "node").select("node", "component", own.alias("doc_id"), F.col("least.key").alias("key")), "members")
    classes = components(verified(docs, members))
    named = nodes.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    best = named.groupBy("class").agg(F.min("least").alias("best"), F.sum("rows").alias("total")).where("total > 1")
    named = stored(split_join(named, best, "class").select("node", "best"), "classes")  # nodes of groups of several rows
    grouped = split_join(rows.select("doc_id", "key", "node"), named, "node")
    stays = F.col("doc_id").eqNullSafe(F.when(~F.col("best.none"), F.col("best.id"))) & (F.col("key") == F.col("best.key"))
    key, of, stay = private(docs, "key", "of", "stay")
    grouped = stored(grouped.groupBy(F.col("key").alias(of)).agg(F.max(stays).alias(stay)), "grouped")  # equal rows are one
    (some,) = private(docs.withColumns({key: F.lit(0), of: F.lit(0), stay: F.lit(0)}), "some")
    keyed = with_mark(docs.withColumn(key, row_key(docs)), F.col(key), grouped.select(F.col(of).alias("key")), some)
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    # equal rows are of one group and become one before they are dealt; a row that only shares a bit of the map stays
    maybe = keyed.where(some).groupBy(key).agg(F.first(F.struct(*columns)).alias(stay + "row")).join(grouped, F.col(key) == F.col(of), "left")
    maybe = maybe.where(F.coalesce(stay, F.lit(True))).select(*(F.col(stay + "row").getField(c).alias(c) for c in docs.columns))
    return keyed.where(~F.col(some)).select(*columns).unionByName(maybe)


def split_join(rows: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """Inner join of many rows with one name per key, where one key may hold a large share of the rows.

    Keys of more than 1 / (4 x buckets) of the rows, so a bounded number, are
    broadcast; all others are dealt by key.
    """
    least = F.broadcast(rows.agg(F.greatest(F.lit(64), F.count("*") / (4 * n_buckets(rows.sparkSession))).alias("least_")))  # one row
    hot = rows.groupBy(on).agg(F.count("*").alias("n_")).join(least, F.col("n_") > F.col("least_")).select(on)
    hot_names = names.join(hot, on, "left_semi")
    return rows.join(F.broadcast(hot_names), on).unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(names, on))
