"""Operators 1 to 6 and 9 against brute force on documents with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.test_neardup import _groups
from erlink.llm import bpe, fmindex, katz, nbsvm, sharding, simhash, suffix, textvec

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_row(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_words_and_hashes_agree_with_regex():
    texts = ["", None, "a b  a", "É\tx\ny", "long" * 3000 + " a", " "]
    w = textvec.split_words(texts, textvec.NON_SPACE, lower=True)
    got = [[w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert got == [SPACE.findall((t or "").translate(LOWER)) for t in texts]
    h = textvec.word_hashes(w, block=64)
    flat = [x for d in got for x in d]
    assert len(set(h.tolist())) == len(set(flat)) and (h == textvec.word_hashes(w)).all()
    for n in (1, 2, 3, 7, 20):
        x = np.arange(30, dtype=np.uint64) % np.uint64(5)
        s = textvec.sequence_hashes(x, n)
        assert len(s) == 31 - n and len(set(s.tolist())) == min(5, 31 - n)


# 1 -----------------------------------------------------------------------------------------------------


def _labelled(n=400):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["river", "stone", "paper", "walks", "green", "slow"]) + rng.choice(["", ".", ","]) for _ in range(30))
    bad = lambda: " ".join(rng.choice(["river", "stone", "paper"]) + rng.choice(["%%%", "$$$", "!!"]) for _ in range(30))
    return [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(n)]


def test_classifier_learns_and_keeps_held_out_rows_out(spark, tables):
    rows = _labelled()
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    lies = spark.createDataFrame([(i, 1 - q if i in held else q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in nbsvm.op1_nbsvm(spark, tables(documents=d, labels=truth)).collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(got[i]["held_out"] == (i in held) for i, _, _ in rows)
    assert np.mean([got[i]["predicted"] == q for i, _, q in rows if i in held]) > 0.97
    again = {r["doc_id"]: r["score"] for r in nbsvm.op1_nbsvm(spark, tables(documents=d, labels=lies)).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-12 for i in got)


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    o, f = nbsvm.indicators([t for _, t, _ in _labelled(60)], bits=10)
    y = np.array([q for _, _, q in _labelled(60)])
    scale = nbsvm.log_ratios(o, f, y, 1 << 10)
    w, b = nbsvm.dual_descent(o, f, scale, y, np.ones(len(y)), epochs=300)

    def objective(w, b):
        total = 0.0
        for k in range(len(y)):
            r = f[o[k] : o[k + 1]]
            v = scale[r] / max(np.linalg.norm(scale[r]), 1e-12)
            total += max(0.0, 1 - (1 if y[k] else -1) * (w[r] @ v + b))
        return 0.5 * (w @ w + b * b) + total

    best = objective(w, b)
    for _ in range(30):
        assert objective(w + rng.normal(0, 0.02, len(w)) * (scale != 0), b + rng.normal(0, 0.02)) >= best - 1e-3


def test_classifier_odd_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = nbsvm.train(docs, none)
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in nbsvm.score(docs, model).collect())
    assert nbsvm.score(no_docs, model).count() == 0
    twice = spark.createDataFrame([(20, 1, 0), (20, 0, 0), (21, None, 0), (22, 1, 0), (23, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert nbsvm.score(docs, nbsvm.train(docs, twice)).count() == docs.count()


# 2 -----------------------------------------------------------------------------------------------------


def _contaminated(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(None if item is None else str(item))
    out = Counter()
    for doc, text in rows:
        w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    found |= s
                    hit.update(range(k, k + n))
        out[(doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit))] += 1
    return out


def _items(rows):
    passage = next(r[1] for r in rows if r[0] == 7).split()
    return [(1, " ".join(passage[3:40])), (2, "One"), (10, " ".join(passage[5:14])), (10, "ab, AB ab"), (3, None), (4, "!!"), (None, passage[0]), (5, "nowhere to be found " * 4), (1, " ".join(passage[3:40]))]


@pytest.mark.parametrize("block", [1 << 24, 300])
def test_contamination(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", block)
    items = _items(rows)
    got = fmindex.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert by_row(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == _contaminated([r[:2] for r in rows], items)


def test_contamination_of_empty_tables(spark, docs, no_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in fmindex.contamination(docs, bench).collect())
    assert fmindex.contamination(no_docs, bench).count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    s = np.concatenate([[0], rng.integers(1, 4, 200), [0], np.tile([1, 2], 40), [0]]).astype(np.int32)
    index = fmindex.FMIndex(s, 3)
    for n in (1, 2, 5, 9):
        patterns = np.array(sorted({tuple(s[k : k + n]) for k in range(len(s) - n) if 0 not in s[k : k + n]}) + [(3,) * n], dtype=np.int32)
        low, high = index.search(patterns.ravel(), np.arange(1, len(patterns) + 1) * n, np.full(len(patterns), n))
        for p, a, b in zip(patterns, low, high):
            want = [k for k in range(len(s) - n + 1) if (s[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_words_that_a_polynomial_confuses(spark):
    """A Thue-Morse word and its complement: equal under any polynomial hash modulo 2**64, but two words."""
    a, b = (("".join(x[bin(k).count("1") % 2] for k in range(1024))) for x in ("ab", "ba"))
    nine = "w0 w1 w2 w3 w4 w5 w6 w7 w8 "
    docs = spark.createDataFrame([(1, nine + a), (2, nine + b)], "doc_id long, text string")
    got = fmindex.contamination(docs, spark.createDataFrame([(1, nine + a)], "item_id long, text string"))
    assert {r["doc_id"]: r["n_hit"] for r in got.collect()} == {1: 10, 2: 0}


def test_words_of_equal_hashes_stay_apart(monkeypatch):
    """Whatever the hash, bytes decide: here it tells only lengths apart until its third seed, and never tells windows apart."""
    true = textvec.word_hashes
    monkeypatch.setattr(fmindex, "word_hashes", lambda w, seed=0: true(w, seed) if seed > 2 else (w.end - w.start).astype(np.uint64))
    monkeypatch.setattr(fmindex, "sequence_hashes", lambda h, n: np.zeros(max(0, len(h) - n + 1), dtype=np.uint64))
    win = fmindex.build_windows([("1", " ".join(f"a{k}" for k in range(30))), ("2", " ".join(f"a{k}" for k in range(11, 22)))])
    _, flags, _, items = fmindex.find([" ".join(f"a{k}" for k in range(11, 21)), " ".join(f"b{k}" for k in range(11, 21)), " ".join(f"a{k}" for k in range(2, 12))], win)
    assert flags.tolist() == [True] * 10 + [False] * 10 + [True] * 10
    assert [[win.item_ids[k] for k in x] for x in items] == [["1", "2"], [], ["1"]]


def test_long_items_are_cut_into_overlapping_pieces(spark, monkeypatch):
    words = [f"w{k % 97}x{k % 89}" for k in range(5000)]
    monkeypatch.setattr(fmindex, "PIECE_BYTES", 2000)
    item = spark.createDataFrame([("long", " ".join(words)), ("short", "a b"), ("none", None)], "item_id string, text string")
    pieces = fmindex._pieces(item, limit=2000).collect()
    assert len(pieces) > 10
    texts = [" ".join(words[k : k + 10]) for k in range(0, len(words) - 9, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    item = item.where("item_id <> 'short'")
    assert {r["n_hit"] for r in fmindex.contamination(docs, item, limit=30_000).collect()} == {10}


@pytest.mark.parametrize("limit", [None, 300])
def test_decontamination_stage_takes_items_without_id_and_odd_columns(spark, tables, limit):
    rows = [(1, "keep this", {"a": 1}, "x"), (2, "say one thing", None, "y"), (2, "say one thing", None, "y"), (None, None, {}, None), (None, "one", {}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id_ map<string,int>, hits string")
    sf = tables(benchmark=spark.createDataFrame([(None, "One"), (7, "zz " * 200)], "item_id long, text string"))
    out = fmindex.decontaminate_stage(spark, docs, sf, limit)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([rows[0], (2, "say thing", None, "y"), (2, "say thing", None, "y"), rows[3]], docs.schema).collect()))
    assert fmindex.decontaminate_stage(spark, docs.limit(0), sf, limit).count() == 0


def test_decontamination_stage_cuts_only_hits(spark, docs, rows, tables):
    sf = tables(benchmark=spark.createDataFrame([i for i in _items(rows) if i[0] is not None], "item_id long, text string"))
    out = fmindex.decontaminate_stage(spark, docs, sf)
    assert out.columns == docs.columns
    after = fmindex.contamination(out, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {r["doc_id"] for r in after.where("contaminated").collect()} <= {None}
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[6] == next(r[1] for r in rows if r[0] == 6) and 4 not in got


# 3 -----------------------------------------------------------------------------------------------------


def test_cuts_are_minimax():
    rng = random.Random(0)

    def best(sizes, k):
        if k == 1 or not sizes:
            return sum(sizes)
        return min(max(sum(sizes[:i]), best(sizes[i:], k - 1)) for i in range(len(sizes) + 1))

    for _ in range(60):
        sizes = [rng.randint(0, 9) for _ in range(rng.randint(0, 8))]
        k = rng.randint(1, 4)
        cuts = sharding.minimax_cuts(sizes, k)
        assert cuts[0] == 0 and cuts[-1] == len(sizes) and len(cuts) == k + 1 and cuts == sorted(cuts)
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])) == best(sizes, k)


def test_sharding(docs, no_docs, rows):
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and all(r["grown_shard"] is None for r in got)
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len(text(r[1])) + 1, zlib.crc32(text(r[1]))) for r in rows)
    slots, home = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        home[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert all(len(s) == 1 for s in home.values())
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    rest = [n for s, n in size.items() if s != max(size, key=size.get)]
    assert len(size) == 8 and max(rest) <= 1.6 * sum(rest) / 7  # one long document fills a shard, the others share evenly
    assert sharding.shard_documents(no_docs).count() == 0


# 4 -----------------------------------------------------------------------------------------------------


def _katz(rows):
    """The model in dictionaries: scores by row, and the sum of the distributions."""
    toks = [(i, zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False, [*SPACE.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    train = [w for _, held, w in toks if not held]
    one = Counter(x for w in train for x in w)
    two = Counter(p for w in train for p in zip(["<s>", *w], w))
    context = Counter()
    for (v, _), n in two.items():
        context[v] += n
    total = sum(one.values())
    count = lambda c: np.array([sum(1 for n in c.values() if n == r) for r in range(katz.K + 2)])
    d1, d2 = katz.good_turing(count(one)), katz.good_turing(count(two))
    star = lambda d, n: d[n - 1] if n <= katz.K else n - katz.EPSILON
    p1 = {w: star(d1, n) / total for w, n in one.items()}
    unknown = 1 - sum(p1.values())
    used, below = defaultdict(float), defaultdict(float)
    for (v, w), n in two.items():
        used[v] += star(d2, n) / context[v]
        below[v] += p1[w]
    bow = {v: (1 - used[v]) / (1 - below[v]) for v in context}
    prob = lambda v, w: star(d2, two[v, w]) / context[v] if (v, w) in two else bow.get(v, 1.0) * p1.get(w, unknown)
    sums = [sum(prob(v, w) for w in one) + bow[v] * unknown for v in list(context)[:20]]
    out = [(i, held, len(w), sum(one[x] > 0 for x in w), total, sum(math.log10((one[x] + 1) / (total + len(one) + 1)) for x in w), sum(math.log10(prob(v, x)) for v, x in zip(["<s>", *w], w))) for i, held, w in toks]
    return out, sums


def test_katz_scores(spark, docs, rows, tables):
    want, sums = _katz([r[:2] for r in rows])
    assert all(abs(s - 1) < 1e-9 for s in sums)
    got = [tuple(r) for r in katz.op4_katz(spark, tables(documents=docs)).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-5) and a[6] == pytest.approx(b[6], abs=1e-5)


def test_katz_without_training_rows(spark, no_docs, tables):
    assert katz.op4_katz(spark, tables(documents=no_docs)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    d = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = katz.op4_katz(spark, tables(documents=d)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (3, 0, 0, 0.0)


# 5 -----------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, rows, no_docs):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    lib, own = Tokenizer.from_file(path), bpe.codec(path)
    odd = ["don't WE'LL ΣΑΣ İ", "<|endoftext|>a<|startoftext|> <|end", "a\x1cb\x1d c\x85d", "é é 한국어 123", "x" * 700, "  ​ ab"]
    for text in [*(r[1] for r in rows if r[0] != 6), *odd]:
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text) == want and own.decode(want) == lib.decode(want, skip_special_tokens=False)
    got = by_row(bpe.encode_documents(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r[0], len(ids), digest(" ".join(map(str, ids))), digest(lib.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.encode_documents(no_docs, path).count() == 0


def test_bpe_scan_heap_and_batch_agree():
    own, rng = bpe.codec(bpe.tokenizer_path()), random.Random(5)
    words = ["".join(rng.choice("etaoinshrdluéß%") for _ in range(rng.randint(1, 40))) for _ in range(200)]
    parts = lambda w: [own.byte_id[b] for b in w.encode()[:-1]] + [own.last_id[w.encode()[-1]]]
    for w, batch in zip(words, own._scan_many([w.encode() for w in words])):
        assert own._scan(parts(w)) == own._heap(parts(w)) == batch


# 6 -----------------------------------------------------------------------------------------------------


def _fingerprint(text):
    w = SPACE.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def _components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {n: root(n) for n in nodes}


def test_simhash_components(spark, docs, rows, no_docs, tables):
    fps = {r[1]: _fingerprint(r[1]) for r in rows}
    group = _components(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r in rows:
        g = group[fps[r[1]]]
        least[g] = min(x for x in (least.get(g), r[0]) if x is not None) if least.get(g) is not None or r[0] is not None else None
    got = by_row(simhash.op6_simhash(spark, tables(documents=docs)), "doc_id", "fingerprint", "component_id")
    assert got == Counter((r[0], f"{fps[r[1]]:016x}", least[group[fps[r[1]]]]) for r in rows)
    assert simhash.near_duplicates(no_docs).count() == 0
    rows = [r[:2] for r in rows]
    group = _groups([t for _, t in rows])  # the stage's groups are by the shingles themselves
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min(x for x in (least.get(g), i) if x is not None) if least.get(g) is not None or i is not None else None
    kept = simhash.dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())


def test_cells_find_every_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 7), replace=False).astype(np.uint64)) for b in base for _ in range(4)]
    chain = np.bitwise_xor.accumulate(np.uint64(1) << np.arange(64, dtype=np.uint64))
    dense = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))  # more than DENSE members of a cell
    fp = np.unique(np.concatenate([base, np.array(near), chain, dense, dense ^ np.uint64(3)]))
    grid = simhash.grid_cells(fp)
    u, v = simhash.cell_links(grid.ravel(), np.tile(fp, len(grid)))
    pairs = set(zip(u.tolist(), v.tolist()))
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs) and len(pairs) < len(fp)
    linked = lambda a, b: (a, b) in pairs or (b, a) in pairs
    assert _components(fp.tolist(), linked) == _components(fp.tolist(), lambda a, b: (a ^ b).bit_count() <= 4)
    x, y = fp[rng.integers(0, len(fp), 500)], fp[rng.integers(0, len(fp), 500)]
    assert (simhash.manhattan(simhash.embed(x), simhash.embed(y)) <= np.bitwise_count(x ^ y)).all()


# 9 -----------------------------------------------------------------------------------------------------


def _deduped(rows, n=20):
    first = {}
    key = lambda i: -1 if i is None else i
    for i, t in rows:
        w = SPACE.findall(t or "")
        for k in range(len(w) - n + 1):
            s = tuple(w[k : k + n])
            first[s] = min(first.get(s, (1 << 60, 0)), (key(i), k))
    out = Counter()
    for i, t in rows:
        w = SPACE.findall(t or "")
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] != (key(i), k):
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("batch", [1 << 24, 3000])
def test_substring_dedup(spark, docs, rows, no_docs, tables, monkeypatch, batch):
    monkeypatch.setattr(suffix, "BATCH_BYTES", batch)
    got = by_row(suffix.op9_suffix(spark, tables(documents=docs)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == _deduped([r[:2] for r in rows])
    assert suffix.op9_suffix(spark, tables(documents=no_docs)).count() == 0


def test_substring_stage(spark, docs, rows):
    out = suffix.substring_stage(spark, docs, "")
    assert out.columns == docs.columns
    want = Counter(r[0] for r in rows)
    gone = {k[0] for k in _deduped([r[:2] for r in rows]) if k[1] and k[1] == k[2]}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({i: n for i, n in want.items() if i not in gone})
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in out.collect())
