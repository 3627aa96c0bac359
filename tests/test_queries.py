"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lorespark.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    show = lambda x: repr(x) if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = registry.queries()[name](spark, DIR).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_python_stages_bound_their_batches(spark):
    """Whatever ran before, a stage of the core bounds its batches, and long texts in one partition come through."""
    from lorespark.functions.batches import BATCH_BYTES
    from lorespark.operators.chunking import Config, chunk_documents

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.range(30).selectExpr("id AS doc_id", "repeat('word and more. ', 70000) AS text").coalesce(1)
    chunks = chunk_documents(docs, Config("fixed", 100_000, 0, 1))
    assert spark.conf.get(name) == str(BATCH_BYTES)
    assert chunks.select("doc_id").distinct().count() == 30
