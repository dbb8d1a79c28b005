"""Every registered query against its DuckDB twin, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from stratagrade.plans import catalogue, files

assert files  # registers its queries
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, tables, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = tables.execute(catalogue.SQL[name])
    want = rows([d[0] for d in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in found.description)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_splits_cover_all_rows(spark, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    assert df.count() == df.select("event_id").distinct().count() == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert df.groupBy("split", "split_pos").count().where("count > 1").isEmpty()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
