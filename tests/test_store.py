import json

import pytest

from lorespark.sources import snapshots as S
from lorespark.streaming import hits, ingest


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string")


def test_versions(spark, tmp_path):
    root = str(tmp_path / "kb")
    assert S.read(spark, root) is None and S.current(spark, root) == {}
    S.publish(spark, root, rows(spark, [(1, "a"), (2, "b")]), index="x")
    held = S.read(spark, root)
    S.upsert(spark, root, rows(spark, [(2, "B"), (3, "c")]), "doc_id")
    assert sorted(map(tuple, S.read(spark, root).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, held.collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        S.publish(spark, root, rows(spark, [(1, "a")]), expected=2)
    assert S.current(spark, root)["version"] == 2
    S.delete(spark, root, rows(spark, [(1, "")]), "doc_id")
    assert sorted(r["doc_id"] for r in S.read(spark, root).collect()) == [2, 3]
    assert not (tmp_path / "kb" / "v=1").exists() and (tmp_path / "kb" / "v=2").exists()


def test_viability():
    made = {"index": 1, "chunking": 2, "tokenizer": 3, "parser": 4}
    assert S.viability(None, made)[0] is False and S.viability(made, made)[0] is True
    assert S.viability(made | {"chunking": None}, made) == (False, "the served version doesn't record its chunking")
    assert S.viability(made, made | {"parser": 5}) == (False, "parser has changed")


def test_torn_log(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n{"a": ')
    got, torn = S.read_log(spark, str(p), "a int")
    assert [r["a"] for r in got.collect()] == [1, 2] and torn == 1
    p.write_text('{"a": 1}\n{"a"\n{"a": 2}\n')
    with pytest.raises(ValueError):
        S.read_log(spark, str(p), "a int")


def test_hits_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(hits.run_to_end(spark, path, "1 day", "event_type")) == key(hits.windowed(spark.read.parquet(path), "1 day", "event_type"))


def test_ingest_stream(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "kb")
    rows(spark, [(1, "first text " * 20), (2, "second text " * 20)]).write.parquet(source)
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(source)
    for more in (None, [(2, "changed text " * 20)]):
        if more:
            rows(spark, more).write.mode("append").parquet(source)
        q = ingest.publish_stream(stream(), root, str(tmp_path / "cp"), ingest.Config("fixed", 100, 0, 1))
        q.processAllAvailable()
        q.stop()
    got = {r["doc_id"]: r["text"] for r in S.read(spark, root).collect()}
    assert got[2].startswith("changed") and got[1].startswith("first")


def test_two_writers(spark, tmp_path):
    """Writers that meet lose nothing: the slower one begins again from what the other published."""
    from pyspark import InheritableThread

    root = str(tmp_path / "shared")
    S.publish(spark, root, spark.range(1).withColumnRenamed("id", "doc_id"))
    before = S.current(spark, root)
    S.publish(spark, root, spark.range(2).withColumnRenamed("id", "doc_id"))
    try:
        S.publish(spark, root, spark.range(9).withColumnRenamed("id", "doc_id"), before=before)
        raise AssertionError("a version was lost")
    except S.Conflict:
        assert S.current(spark, root)["rows"] == 2
    failed = []

    def write(i):
        try:
            for j in range(3):
                S.upsert(spark, root, spark.range(100 * i + j, 100 * i + j + 1).withColumnRenamed("id", "doc_id"), "doc_id")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [InheritableThread(target=write, args=(i,)) for i in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not failed
    assert sorted(r["doc_id"] for r in S.read(spark, root).collect()) == [0, 1, *(100 * i + j for i in (1, 2, 3) for j in range(3))]


def test_broken_log(spark, tmp_path):
    import pytest

    (tmp_path / "log").write_text('{"a": 1}\n{"a\n\n{"a": 2}\n')
    with pytest.raises(ValueError):
        S.read_log(spark, str(tmp_path / "log"), "a int")
    (tmp_path / "torn").write_text('{"a": 1}\n\n{"a": 2}\n{"a')
    rows, torn = S.read_log(spark, str(tmp_path / "torn"), "a int")
    assert [r["a"] for r in rows.collect()] == [1, 2] and torn == 1


def test_a_writer_that_stopped(spark, tmp_path):
    """A writer that stopped between its claim and the pointer holds nobody up; one that comes back late publishes nothing."""
    root = str(tmp_path / "kb")
    first = S.publish(spark, root, rows(spark, [(1, "a")]))
    S.publish(spark, root, rows(spark, [(1, "b")]))
    S.write_text(spark, f"{root}/CURRENT", json.dumps(first))  # as if the second writer had died before it moved the pointer
    assert [r["text"] for r in S.read(spark, root).collect()] == ["b"] and S.current(spark, root)["version"] == 2
    with pytest.raises(S.Conflict):
        S.publish(spark, root, rows(spark, [(9, "late")]), before=first)
    S.upsert(spark, root, rows(spark, [(2, "c")]), "doc_id")
    assert sorted(map(tuple, S.read(spark, root).collect())) == [(1, "b"), (2, "c")]
