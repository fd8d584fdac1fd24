"""The near-duplicate stage against brute force over all pairs of shingle sets."""

import random
from collections import Counter

import numpy as np
import pytest

from erlink.llm import neardup, simhash


def _shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def _groups(texts):
    """Component number of each text under Jaccard similarity >= 0.8 (equal sets are alike)."""
    sets = [_shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


def _edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = [None, "", "  ", "one", "One", "one two", "a b c d e", "A b c d e", "a b c d e f"]
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        out += [" ".join(_edited(rng, words, round(len(words) * share))) for share in (0, 0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08)]
    return out


def test_stage_keeps_one_of_each_group(spark, texts):
    rows = [(k if k % 9 else None, t, {"k": k}, "x", k) for k, t in enumerate(texts)]
    rows += rows[:30:3]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, key map<string,int>, node string, `of_` long").repartition(5)
    out = simhash.dedup_stage(spark, docs, "")
    assert out.schema == docs.schema
    got = out.collect()
    group = _groups(texts)
    left = Counter(group[r["of_"]] for r in got)
    assert set(left) == set(group)  # no group is lost
    missed = sum(left.values()) - len(left)
    assert missed <= 0.02 * len(texts), missed  # a link near 0.8 may share no cell
    for r in got:  # the smallest id of a whole group stays
        ids = [row[0] for row in rows if group[row[4]] == group[r["of_"]] and row[0] is not None]
        if left[group[r["of_"]]] == 1:
            assert r["doc_id"] == min(ids, default=None)


def test_links_equal_brute_force_inside_proposed_groups(texts):
    sets = neardup.shingle_sets(texts)
    group = list(range(len(sets)))
    for a, b in neardup.jaccard_links(sets):
        group = [group[a] if g == group[b] else g for g in group]
    assert len(set(group)) == len(set(_groups(texts)))
    want = _groups(texts)
    assert len(set(zip(group, want))) == len(set(want))


def test_cut_groups_lose_no_link(spark, texts, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 7)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    keys = {r[0]: r[1] for r in docs.select("doc_id", neardup.row_key(docs)).collect()}
    nodes, node = {}, {}
    for k, s in enumerate(neardup.shingle_sets(texts)):
        node[k] = nodes.setdefault(s.tobytes(), k)
    members = spark.createDataFrame([(k, 0, k, keys[k]) for k in sorted(set(node.values()))], "node long, component long, doc_id long, key long")
    group = list(range(len(texts)))
    for r in neardup.verified(docs, members).collect():
        group = [group[r["u"]] if g == group[r["v"]] else g for g in group]
    want = _groups(texts)
    assert len({group[node[k]] for k in node}) == len(set(want)) == len({(group[node[k]], want[k]) for k in node})


def test_recall_of_the_grids():
    """Pairs of similarity 0.8 to 0.95 share a cell in nine of ten cases or more, among some thousand other texts."""
    rng = random.Random(2)
    texts, pairs = [], []
    for k in range(300):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(words), " ".join(_edited(rng, words, rng.choice([1, 2, 3, 4])))]
        pairs.append((2 * k, 2 * k + 1))
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(3000)]
    sets = neardup.shingle_sets(texts)
    fp = np.array([neardup.majority(s) for s in sets])
    key = neardup.cells(fp, neardup.grids(len(fp)))
    u, v = neardup.cell_links(key.ravel(), np.tile(np.arange(len(fp)), len(key)), np.tile(fp, (len(key), 1)))
    name = dict(zip(u.tolist(), v.tolist()))
    good = [(a, b) for a, b in pairs if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    assert len(good) > 200 and sum(name.get(a) == name.get(b) is not None for a, b in good) >= 0.9 * len(good)


def test_empty_docs(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.dedup_stage(spark, docs, "").count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert simhash.dedup_stage(spark, one, "").count() == 1
