"""Operators 7, 8 and 10, components, blobs, and the pipeline."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from erlink.llm import chat, common, components, pq, tagpath


def test_blobs_round_trip():
    rng = np.random.default_rng(0)
    for v in (np.empty(0, np.uint64), np.array([0]), rng.integers(0, 1 << 63, 1000).astype(np.uint64), np.arange(300)):
        assert (common.unpack(common.pack(v)) == v.astype(np.uint64)).all()
        s = np.sort(v.astype(np.uint64))
        assert (common.unpack_sorted(common.pack_sorted(s)) == s).all()


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 200), (200, 200)]
    got = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    want = {i: 0 for i in range(61)} | {x: 100 for x in range(100, 160)} | {200: 200, 201: 200}
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def _vectors():
    rng = np.random.default_rng(4)
    rows, base = [], rng.normal(size=(30, 16))
    for i in range(300):
        v = base[i % 30] + rng.normal(size=16) * (0.02 if i % 3 else 0.4)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(300 + k, rows[3][1], 1) for k in range(40)]  # copies
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [math.nan] * 16, 0), (403, [1.0] * 15 + [None], 0), (404, rows[0][1], None), (405, [1.0, 2.0], 0), (406, [1.0, 2.0001], 0), (407, [], 0), (None, rows[0][1], 0), (5, rows[5][1], 1)]
    return rows


def test_embedding_links(spark, tables):
    rows = _vectors()
    df = spark.createDataFrame([(i, e, y, 1, 2) for i, e, y in rows], "vec_id long, embedding array<float>, label int, rep int, cell int")
    good = [(k, i, np.array(e, dtype=np.float64), y) for k, (i, e, y) in enumerate(rows) if i is not None and y is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    linked = {k: set() for k, *_ in good}
    for k, _, x, y in good:
        for m, _, z, t in good:
            if k != m and y == t and len(x) == len(z) and x @ z / (np.linalg.norm(x) * np.linalg.norm(z)) >= 0.98:
                linked[k].add(m)
    ids = dict((k, i) for k, i, *_ in good)
    want = Counter()
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in linked.get(todo.pop(), ()):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        c = min((ids[m] for m in seen if m in ids), default=i)
        want[(i, len(linked.get(k, ())), c, i is not None and c == i)] += 1
    got = Counter(tuple(r) for r in pq.op7_pq(spark, tables(embeddings=df)).collect())
    assert got == want
    for cells in (1, 9):
        assert Counter(tuple(r) for r in pq.near_duplicates(df, cells=cells).collect()) == want
    assert pq.near_duplicates(df.limit(0)).count() == 0


def test_product_quantiser_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = pq.fit(x, 8)
    home, mask = pq.probes(q, x, 0.3)
    for c in range(8):
        members = x[home == c]
        if len(members):
            codes, error = pq.encode(q, members - q.centroids[c])
            true = np.sqrt(((x[:, None] - members[None]) ** 2).sum(2))
            assert (pq.table_distances(q, c, x, codes) - error <= true + 1e-9).all()
            assert mask[:, c][(true <= 0.3).any(1)].all()


PAGES = {
    "article": ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home, page.</a></nav><div class='ad'>Buy, now. Cheap!</div><article><h1>Head &amp; line</h1><p><b>One,  two.<br>Three<p>Four &#8212; five.</article><footer>&copy; site, all rights.</footer></body>", "Head & line\n\nOne, two. Three\n\nFour — five."),
    "plain containers": ("<body><header><h1>Site</h1></header><div id='menu'><ul><li>Home<li>About</ul></div><div class='content'><h2>Title</h2><p>A first paragraph, with text; and more of it.</p><ul><li>one, two.<li>three</ul></div><div id='comments'><p>Nice article, thanks a lot. I liked it, really.</p></div><form><p>Sign up, please.</p></form></body>", "Title\n\nA first paragraph, with text; and more of it.\n\none, two.\n\nthree"),
    "script text": ("<article><script>var t = '</p><p>no, no.</p>';</script><p>Yes, this.</p><!-- <p>hidden, too.</p> --></article>", "Yes, this."),
    "bare text": ("just &lt;text&gt;, no tags", "just <text>, no tags"),
    "aside in article": ("<article><p>Kept, text.</p><aside><p>Dropped, text.</p></aside><div class='newsletter-signup'>Join us, now.</div><div class='shadow'>Also, kept.</div></article>", "Kept, text.\n\nAlso, kept."),
    "empty": ("", ""),
    "no text": ("<html><body><img src=x></body></html>", ""),
    "broken": ("<article><p>An open <b>tag, here", "An open tag, here"),
}


@pytest.mark.parametrize("name", PAGES)
def test_extraction(name):
    page, want = PAGES[name]
    assert tagpath.extract(page) == want


def test_extraction_query(spark, tables):
    rows = [(k, f"u{k}", p, "x") for k, (p, _) in enumerate(PAGES.values())] + [(90, None, None, "x"), (91, "u", "<article>" + "<p>Long, text. </p>" * 20_000, "x"), (0, "u0", PAGES["article"][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [r for r in tagpath.op8_tag_path(spark, tables(pages=df)).collect()]
    want = Counter((r[0], r[1], tagpath.extract(r[2]), len(tagpath.extract(r[2]))) for r in rows)
    assert Counter(tuple(r) for r in got) == want and max(r["n_chars"] for r in got) == 20_000 * 13 - 2
    assert tagpath.extract_pages(df.limit(0)).count() == 0


def test_rendering_finds_spans_and_rewrites():
    t = chat.MarkedTemplate()
    turns = [("user", "a\\</s>\\"), ("assistant", "<|im_end|>\n<"), ("as\n<\\x", ""), ("assistant", "[INST] <<SYS>> [/INST]</s>")]
    text, spans, rewrites = chat.render(t, turns)
    assert not rewrites and t.parse(text) == turns and [t.unescape(text[s.text_start : s.text_end]) for s in spans] == [x for _, x in turns]
    assert "".join(text[s.start : s.end] for s in spans) == text
    many = [("user", f"q{i}") for i in range(100)]
    assert chat.render(t, many)[0] == t(many)
    drops = lambda ts: "".join(f"[{r}]{'' if r == 'assistant' and i < len(ts) - 1 else x};" for i, (r, x) in enumerate(ts))
    text, spans, rewrites = chat.render(drops, [("user", "q"), ("assistant", "x"), ("user", "z")])
    assert rewrites and [text[s.text_start : s.text_end] for s in (spans[0], spans[2])] == ["q", "z"] and spans[1].start == -1


class LastForty(chat.MarkedTemplate):
    """Drops all but the last 40 turns."""

    def __call__(self, turns):
        return super().__call__(turns[-40:])


class Early(chat.MarkedTemplate):
    """Changes the first turn once there are more than 70."""

    def __call__(self, turns):
        return super().__call__([("system", "long")] * (len(turns) > 70) + turns[len(turns) > 70 :])


@pytest.mark.parametrize("template", [LastForty(), Early(), chat.MarkedTemplate()])
@pytest.mark.parametrize("n", [1, 39, 45, 50, 100, 333])
def test_rewrites_are_detected_at_any_length(template, n):
    turns = [("user" if k % 2 else "assistant", f"turn {k}\\ </s>") for k in range(n)]
    whole = template(turns)
    rewrites = isinstance(template, LastForty) and n > 40 or isinstance(template, Early) and n > 70
    text, spans, found = chat.render(template, turns)
    assert (text, found) == (whole, rewrites)
    kept = [(k, s) for k, s in enumerate(spans) if s.start >= 0]
    assert [template.unescape(whole[s.text_start : s.text_end]) for _, s in kept] == [turns[k][1] for k, _ in kept]
    reading = chat._Reading(1, template)
    for turn in turns:
        reading.add(turn)
    loss = "".join(turns[k][1] for k, _ in kept if turns[k][0] == "assistant")
    read = template.parse(whole)
    want = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in read).encode()).hexdigest()
    assert reading.row() == (1, len(read), want, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole), rewrites)


def test_conversations_beyond_memory(monkeypatch):
    monkeypatch.setattr(chat, "HELD", 500)
    turns = [("user", f"turn {k} " * 3) for k in range(300)]
    reading = chat._Reading(1, chat.MarkedTemplate())
    for turn in turns:
        reading.add(turn)
        assert len(reading.prefixes.turns) < 60
    assert reading.row()[1] == 300 and reading.row()[5:] == (len(chat.MarkedTemplate()(turns)), False)
    with pytest.raises(ValueError):
        reading = chat._Reading(1, LastForty())
        for turn in [("user", "x" * 12)] * 300:
            reading.add(turn)


def test_rewriting_template_in_the_operator(spark):
    rows = spark.createDataFrame([(c, k, "assistant", f"t{k}") for c in (1, 2) for k in range(50 if c == 1 else 5)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(rows, LastForty()).collect()}
    assert [got[c]["rewrites"] for c in (1, 2)] == [True, False]
    assert got[1]["formatted_chars"] == len(LastForty()([("assistant", f"t{k}") for k in range(50)])) and got[1]["n_turns"] == 40


def test_chat_query(spark, tables):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "<|x|> \\ é"), (2, 1, "b", "later"), (2, 0, "a", "first"), (2, 0, "a", "first"), (None, 0, None, "n"), (3, 0, "assistant", "x" * 100_000), *[(4, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(90)]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: r for r in chat.op10_chat(spark, tables(conversations=df)).collect()}
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    t = chat.MarkedTemplate()
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        loss = "".join(x for r, x in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (conv, len(turns), digest("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), digest(loss), len(t(turns)), False)
        assert tuple(got[conv]) == want
    assert {r["conv_id"] for r in chat.op10_chat(spark, tables(conversations=df.limit(0))).collect()} == {-7}


def test_pipeline_stages(spark, rows, tables):
    import corpus_pipeline
    from tests.llm.conftest import SCHEMA
    from tests.llm.test_text_operators import _contaminated, _deduped, _items, _labelled

    extra = [(1000 + i, t, "en", "s", len(t), i, "x") for i, t, _ in _labelled(200)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    marks = spark.createDataFrame([(1000 + i, q, 0) for i, _, q in _labelled(200)], "doc_id long, quality int, toxic int")
    sf = tables(documents=docs, labels=marks, benchmark=spark.createDataFrame(_items(rows), "item_id long, text string"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding"]
    frames = [spark.read.parquet(f"{sf}/documents.parquet")]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], sf).write.parquet(f"{sf}/stage{k}")
        frames.append(spark.read.parquet(f"{sf}/stage{k}"))
    for f in frames[1:5]:
        assert f.columns == docs.columns
    pairs = [[(r["doc_id"], r["text"]) for r in f.collect()] for f in frames[:5]]
    bad = {1000 + i for i, _, q in _labelled(200) if not q}
    good = {1000 + i for i, _, q in _labelled(200) if q}
    left = {i for i, _ in pairs[1]}
    assert len(left & bad) <= 2 and len(left & good) >= 0.98 * len(good)
    assert len({i for i, _ in pairs[2]}) == len([i for i, _ in pairs[2]])
    gone = _deduped(pairs[2])
    assert {i for i, _ in pairs[3]} == {k[0] for k in gone if not (k[1] and k[1] == k[2])}
    assert not any(k[2] for k in _contaminated([p for p in pairs[4]], _items(rows)) if k[0] is not None)
    assert frames[5].count() == len(pairs[4])
    run = corpus_pipeline.run(spark, sf)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, frames[5].collect()))
