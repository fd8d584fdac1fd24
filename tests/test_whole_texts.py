"""Text queries must read whole documents, not prefixes; expected values are brute force in plain Python."""

import unicodedata

import pytest

from erlink.functions import text
from erlink.plans import catalogue

LONG = "word " * 60  # 300 characters, more than any former prefix
DOCS = [(1, LONG + "Tail, ÉNDE!"), (2, LONG + "राम"), (3, "short -- One"), (4, ""), (5, "1 2 3 " * 80), (6, "1 2 3 " * 80 + "राम")]


def _cleaned(s):
    return " ".join("".join(c if c.isspace() or unicodedata.category(c)[0] in "LNM" else " " for c in s.lower()).split())


@pytest.fixture()
def sf(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def _got(spark, sf, name):
    return {r[0]: tuple(r)[1:] for r in catalogue.queries()[name](spark, sf).collect()}


def test_clean_text(spark, sf):
    assert _got(spark, sf, "q_clean_text") == {i: (_cleaned(t),) for i, t in DOCS}


def test_idf_token_set(spark, sf):
    assert _got(spark, sf, "q_idf_token_set") == {i: (" ".join(sorted(set(_cleaned(t).split()))),) for i, t in DOCS}


def test_script(spark, sf):
    assert _got(spark, sf, "q_script") == {1: ("latin",), 2: ("mixed",), 3: ("latin",), 4: ("none",), 5: ("none",), 6: ("indic",)}


def test_normalize_unicode(spark, sf):
    assert _got(spark, sf, "q_normalize_unicode") == {i: (text.normalized(t), text.folded(t), text.romanized(t)) for i, t in DOCS}
