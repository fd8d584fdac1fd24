"""Every pipeline stage on empty tables, map columns and columns named like the operators' own."""

import pytest

import corpus_pipeline

NAMES = ["__id", "__hash", "id_", "of_", "starts_", "key", "hits_", "stay_", "node", "score", "fp", "hash"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, m map<string,array<int>>, " + ", ".join(f"`{n}` string" for n in NAMES)
ROWS = [
    (1, "first text of some words, " * 8, "en", "s", 208, {"a": [1, None]}, *NAMES),
    (1, "first text of some words, " * 8, "en", "s", 208, {"a": [1, None]}, *NAMES),
    (2, None, None, None, None, None, *([None] * len(NAMES))),
    (None, "", "en", None, 0, {}, *NAMES),
    (None, "a null id and a text that no other row has", "en", None, None, {}, *NAMES),
    (5, "x" * 100_000 + " long word " * 20_000, "en", "s", 1, {}, *NAMES),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, tables, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    sf = tables(documents=docs, labels=labels, benchmark=spark.createDataFrame([(1, "no such words"), (None, None)], "item_id long, text string"))
    out = stage(spark, docs, sf)
    if name == "BPE encoding":
        assert out.count() == len(ROWS)
    else:
        assert out.schema.names == docs.schema.names
        assert {r["doc_id"] for r in out.collect()} <= {1, 2, 5, None} and out.count() >= 4
    empty = stage(spark, docs.limit(0), sf)
    assert empty.count() == 0
    bare = tables(labels=labels.limit(0), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert stage(spark, docs, bare).count() >= 4
