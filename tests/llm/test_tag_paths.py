"""Ratios of whole tag paths select the content; marks and class names are odds only."""

import math
import random
import re
import time

import pytest

from erlink.llm import tagpath

MAIN = "<p>The main text, which is long; it goes on, and on, with commas.</p>" * 4
TEXT = "\n\n".join(["The main text, which is long; it goes on, and on, with commas."] * 4)


def brute_force(rows, share):
    """Texts of the paths whose smoothed, fused ratios reach ``share``; rows are (whole path as a tuple, text)."""
    same = lambda p: [t for q, t in rows if q == p]
    length = [sum(map(len, same(p))) / len(same(p)) for p, _ in rows]
    marks = [sum(len(re.findall("[.,;:!?]", t)) for t in same(p)) / len(same(p)) for p, _ in rows]

    def smooth(v, i):
        near = [(math.exp(-((i - j) ** 2) / 2), v[j]) for j in range(max(0, i - 2), min(len(v), i + 3))]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    fused = [math.sqrt(length[i] * (1 + marks[i]) * smooth(length, i) * (1 + smooth(marks, i))) for i in range(len(rows))]
    weight = {p: sum(f for (q, _), f in zip(rows, fused) if q == p) / len(same(p)) for p, _ in rows}
    return [t for p, t in rows if weight[p] >= share * max(weight.values())]


def test_ratios_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        rows, page = [], []
        for _ in range(rng.randint(1, 25)):
            kind = rng.choice("abcde")  # sections of one level, so that content has no neighbours in its containers
            text = " ".join(rng.choice(["word", "word,", "end.", "x"]) for _ in range(rng.randint(1, 60)))
            rows.append((("body", f"section.{kind}", "div"), text))
            page.append(f'<section class="{kind}"><div>{text}</div></section>')
        got = tagpath.extract("<body>" + "".join(page))
        assert got == "\n\n".join(brute_force(rows, tagpath.SHARE))


def test_ratios_decide(monkeypatch):
    page = f"<body><div class=x><div>Home</div><div>About us</div></div><div class=y>{MAIN}</div><div class=z><div>More</div></div>"
    assert tagpath.extract(page) == TEXT
    monkeypatch.setattr(tagpath, "path_weights", lambda found: {k: 1.0 for k, _ in found})
    assert tagpath.extract(page) != TEXT


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><div class='layout with-sidebar'><article>{MAIN}</article></div>", TEXT),
        (f"<body><div class=no-header><main>{MAIN}</main></div>", TEXT),
        (f"<article>{MAIN}<p class=legal>Legal, here.</p></article>", TEXT + "\n\nLegal, here."),
        (f"<article><p title=x'y>{MAIN}</article>", TEXT),
        (f"<article>{MAIN}<div class=ad>Buy now!</div><section class=comments><div class=comment><p>Nice, thanks.</p></div></section></article>", TEXT),
        (f"<div class=content>{MAIN}</div><div class=comments><p>Nice one, thanks.</p></div>", TEXT),
        ("", ""),
        (None, ""),
        ("<!-- only a comment", ""),
        ("<p title='never closed>text", ""),
    ],
)
def test_pages(page, want):
    assert tagpath.extract(page) == want


def test_deep_nesting_is_linear():
    began = time.time()
    assert tagpath.extract("<div>x" * 20_000).count("x") == 20_000
    tagpath.extract("<i><div>" + "<b>" * 20_000 + "</i>" * 20_000 + "<li>y" * 20_000)
    assert time.time() - began < 10


def test_unmarked_pages_of_the_tables():
    """Without the article element, ratios alone find nearly all of what it held."""
    import os

    import pyarrow.parquet as pq

    at = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    right = total = extra = 0
    for page in pq.read_table(at, columns=["html"]).column(0).to_pylist():
        want = set(tagpath.extract(page).split("\n\n"))
        got = set(tagpath.extract(re.sub("<(/?)article>", r"<\1div>", page)).split("\n\n"))
        right, total, extra = right + len(want & got), total + len(want), extra + len(got - want)
    assert right / total > 0.95 and extra / total < 0.05, (right, total, extra)
