"""The store as a data source, and state that streams keep."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorespark.operators import chunking
from lorespark.sources import datasource
from lorespark.sources.store import BUCKETS, Store, bucket_of
from lorespark.streaming import ingest, state


@pytest.fixture
def load(spark):
    datasource.register(spark)
    return lambda root, **options: spark.read.format(datasource.NAME).options(table="t", **options).load(root)


def commit(store, **changes):
    t = store.begin()
    for how, rows in changes.items():
        getattr(t, how)("t", rows, "id")
    return t.commit()


def pairs(df):
    return sorted((r["id"], r["v"]) for r in df.collect())


def test_buckets_agree(spark):
    for values in ([0, 1, -7, 2**62, 123456789], ["", "a", "доклад", "x" * 100]):
        rows = spark.createDataFrame([(v,) for v in values], "k long" if isinstance(values[0], int) else "k string")
        assert {r["k"]: r["b"] for r in rows.select("k", bucket_of("k", BUCKETS).alias("b")).collect()} == {v: datasource.bucket(v) for v in values}


def test_source(spark, load, tmp_path):
    root = str(tmp_path / "store")
    store = Store(spark, root)
    make = lambda lo, hi, v: spark.range(lo, hi).select("id", F.lit(v).alias("v"))
    commit(store, append=make(0, 300, "a"))
    first = load(root)
    commit(store, upsert=make(100, 200, "b"))
    commit(store, delete=make(150, 250, "").select("id"))
    commit(store, append=make(160, 170, "c"))
    want = sorted([(i, "a") for i in range(100)] + [(i, "b") for i in range(100, 150)] + [(i, "c") for i in range(160, 170)] + [(i, "a") for i in range(250, 300)])
    assert pairs(load(root)) == want == pairs(store.read("t"))
    assert pairs(load(root, version=2)) == pairs(store.read("t", 2))
    #: A frame stays with the version that was served when it was loaded.
    assert pairs(first) == [(i, "a") for i in range(300)]
    assert store.compact("t", 2) and pairs(load(root)) == want
    assert sorted(load(root).where("v = 'c'").toPandas()["id"]) == list(range(160, 170))


def test_lookup_opens_one_bucket(spark, load, tmp_path):
    root = str(tmp_path / "store")
    store = Store(spark, root)
    commit(store, append=spark.range(1000).select("id", F.lit("a").alias("v")))
    commit(store, delete=spark.range(5).select("id"))
    all_files = load(root).rdd.getNumPartitions()
    assert all_files >= BUCKETS
    one = load(root).where("id = 77")
    assert pairs(one) == [(77, "a")] and one.rdd.getNumPartitions() <= all_files // BUCKETS + 1
    several = load(root).where(F.col("id").isin(3, 77, 900, 5000))
    assert pairs(several) == [(77, "a"), (900, "a")] and several.rdd.getNumPartitions() <= 4
    assert pairs(load(root).where("id = 77 AND id = 78")) == [] and pairs(load(root).where("id IS NULL")) == []


def test_null_keys_and_string_keys(spark, load, tmp_path):
    root = str(tmp_path / "store")
    store = Store(spark, root)
    commit(store, append=spark.createDataFrame([("x", "1"), (None, "2"), ("y", None)], "id string, v string"))
    commit(store, delete=spark.createDataFrame([("x",), (None,)], "id string"))
    assert {tuple(r) for r in load(root).collect()} == {(None, "2"), ("y", None)} == {tuple(r) for r in store.read("t").collect()}
    assert [tuple(r) for r in load(root).where("id = 'y'").collect()] == [("y", None)]


def test_source_says_what_is_missing(spark, load, tmp_path):
    with pytest.raises(Exception, match="no version"):
        load(str(tmp_path / "none")).collect()
    commit(Store(spark, str(tmp_path / "s")), append=spark.range(1).withColumn("v", F.lit("a")))
    with pytest.raises(Exception, match="no table"):
        spark.read.format(datasource.NAME).option("table", "other").load(str(tmp_path / "s"))


def test_changed_documents_after_a_restart(spark, tmp_path):
    source, where = str(tmp_path / "in"), str(tmp_path / "out")

    def run(*data):
        spark.createDataFrame(list(data), "doc_id long, text string, at long").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string, at long").parquet(source)
        rows = state.run_to_end(state.changed_documents(stream), where, "append")
        last = rows.agg(F.max("_batch")).first()[0]
        return sorted((tuple(r) for r in rows.collect()), key=str), last

    got, _ = run((1, "a", 1), (2, "b", 1), (2, "c", 2), (3, None, 1), (None, "lost", 1))
    assert [r[:2] for r in got] == [(1, "a"), (2, "c"), (3, None)]
    again, _ = run((1, "a", 5), (2, "c", 5), (3, None, 5))
    assert again == got
    more, last = run((1, "b", 6), (2, "c", 6), (3, "d", 6), (4, "", 6))
    assert sorted((r[:2] for r in more if r[2] == last), key=str) == [(1, "b"), (3, "d"), (4, "")]


def test_unchanged_documents_are_not_chunked_again(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "kb")
    store = Store(spark, root)

    def run(*data):
        spark.createDataFrame(list(data), "doc_id long, text string").write.mode("append").parquet(source)
        q = ingest.publish_stream(spark.readStream.schema("doc_id long, text string").parquet(source), root, str(tmp_path / "cp"), chunking.Config("fixed", 100, 0, 1), skip_unchanged=True)
        q.processAllAvailable()
        q.stop()
        return {r["doc_id"] for r in store.read("rows").collect()}, store.record()

    both, first = run((1, "one " * 30), (2, "two " * 30))
    assert both == {1, 2}
    same, second = run((1, "one " * 30), (2, "two " * 30))
    assert same == both and second["version"] == first["version"]
    _, third = run((1, "one " * 30), (2, "new " * 30))
    assert {r["doc_id"] for r in store.changes("rows", first["version"]).collect()} == {2} and third["version"] == first["version"] + 1
    assert {r["text"][:3] for r in store.read("rows").where("doc_id = 2").collect()} == {"new"}


def test_hits_expire(spark, tmp_path):
    source, where, start = str(tmp_path / "in"), str(tmp_path / "out"), datetime(2024, 3, 1)

    def run(*data):
        spark.createDataFrame([(start + timedelta(hours=h), k) for h, k in data], "ts timestamp, key string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, key string").parquet(source)
        rows = state.run_to_end(state.live_hits(stream, "key"), where, "update")
        return {r["key"]: r["hits"] for r in state.current(rows).collect()}

    assert run((0, "a"), (0.5, "a"), (1, "b")) == {"a": 2, "b": 1}
    assert run((100, "b")) == {"a": 2, "b": 2}
    assert run((0.2, "a"), (99.5, "b")) == {"a": 2, "b": 3}  # the watermark is at 99 hours
    assert run((7 * 24 + 2.5, "c")) == {"b": 3, "c": 1}  # the watermark is at 169.5 hours, a's hour ended seven days ago
    assert run((7 * 24 + 3.5, "c")) == {"b": 2, "c": 2}
