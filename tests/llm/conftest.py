import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and long texts, copies, near copies, shared passages, repeated rows and columns with names that operators use inside."""
    rng = random.Random(7)
    passage = words(rng, 60)
    out = [(None, "a null id has words too " + passage), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "One"), (5, "ÀÉ émigré Ünïcode x \U0001f600"), (6, words(rng, 30_000)), (7, passage), (7, passage), (8, "ab " * 50)]
    copy = words(rng, 120)
    for i in range(20, 140):
        kind = i % 6
        text = copy if kind == 0 else copy + f" tail{i}" if kind == 1 else words(rng, 15) + " " + passage + " " + words(rng, 9) if kind == 2 else words(rng, rng.randint(1, 200))
        out.append((i, text))
    return [(i, t, "en", f"src{(i or 0) % 3}", len(t) if t is not None else None, i, "x") for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes DataFrames as the tables of a folder and gives its path."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
