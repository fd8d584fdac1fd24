"""Every registered query against its SQL on the smallest tables; names and values must match."""

import os

import pytest

import __spark_entry__ as entry
from erlink.plans import catalogue

SF = os.environ.get("ERLINK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: float(x) if isinstance(x, (int, float)) else str(x)
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    assert table_of(df.columns, map(tuple, df.collect())) == table_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"q_all_features"}))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source1_entity_id", "matched_entity_ids"]
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
