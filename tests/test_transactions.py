"""The transactional store against a plain dictionary, with writers that meet."""

import os
import random
import threading

import pytest
from pyspark import InheritableThread

from lorespark.sources import store as S


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string")


def state(store, name="docs", record=None):
    found = store.read(name, record)
    return sorted(map(tuple, found.collect())) if found is not None else None


def written(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def test_changes_and_versions(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "kb"))
    assert s.read("docs") is None and s.versions() == [] and s.meta == {}
    rng, want, history = random.Random(1), {}, {}
    for step in range(14):
        t = s.begin()
        kind = rng.choice(["append", "upsert", "delete", "replace" if step in (0, 9) else "upsert"])
        keys = rng.sample(range(40), rng.randint(1, 8))
        if kind == "append" or step == 0:
            keys = [k for k in keys if k not in want] or [100 + step]
            t.append("docs", rows(spark, [(k, f"{step}-{k}") for k in keys]), "doc_id")
            want |= {k: f"{step}-{k}" for k in keys}
        elif kind == "upsert":
            t.upsert("docs", rows(spark, [(k, f"{step}-{k}") for k in keys[1:]]), "doc_id", changed=rows(spark, [(k, "") for k in keys]))
            want = {k: v for k, v in want.items() if k not in keys} | {k: f"{step}-{k}" for k in keys[1:]}
        elif kind == "delete":
            t.delete("docs", rows(spark, [(k, "") for k in keys]), "doc_id")
            want = {k: v for k, v in want.items() if k not in keys}
        else:
            t.replace("docs", rows(spark, [(k, "new") for k in keys]), "doc_id")
            want = {k: "new" for k in keys}
        done = t.commit(step=step)
        history[done["version"]] = sorted(want.items())
        assert state(s) == sorted(want.items()), (step, kind)
        assert s.meta == {"step": step} and len(s.record()["tables"]["docs"]["segments"]) < S.SEGMENTS
    for version, held in history.items():
        assert state(s, record=version) == held
    some = sorted(want)[:2] + [999]
    assert sorted(map(tuple, s.read("docs", keys=some).collect())) == sorted((k, want[k]) for k in some if k in want)
    assert s.vacuum(older_than=-10) > 0 and state(s) == sorted(want.items()) and len(s.versions()) == 1


@pytest.mark.parametrize("kind, key", [("long", int), ("string", lambda i: f"k'{i}")])
def test_many_keys_open_their_buckets(spark, tmp_path, kind, key):
    s = S.Store(spark, str(tmp_path / "many"), buckets=64)
    t = s.begin()
    t.append("docs", spark.createDataFrame([(key(i), str(i)) for i in range(300)] + [(None, "none")], f"doc_id {kind}, text string"), "doc_id")
    t.commit()
    asked = [key(i) for i in range(250, 250 + 2 * S.FEW_KEYS)]
    for keys in (asked, asked[:5], [*asked, None, asked[0]]):
        assert sorted(r["text"] for r in s.read("docs", keys=keys).collect()) == sorted(str(i) for i in range(300) if key(i) in keys)
    assert s.read("docs", keys=[None] * 100).count() == 0
    one = [asked[0]] * (S.FEW_KEYS + 1)
    assert "_bucket" in s.read("docs", keys=one)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_bytes_follow_the_change(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "kb"), buckets=4)
    t = s.begin()
    t.append("docs", spark.range(20_000).selectExpr("id as doc_id", "sha2(cast(id as string), 512) as text"), "doc_id")
    t.commit()
    first = written(tmp_path)
    for i in range(3):
        t = s.begin()
        t.upsert("docs", rows(spark, [(i, "changed")]), "doc_id")
        t.commit()
    assert written(tmp_path) - first < first / 50
    assert s.read("docs").count() == 20_000 and s.read("docs").where("text = 'changed'").count() == 3
    one = s.read("docs", keys=[7])
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_deletions_and_compaction(spark, tmp_path):
    """A merged segment keeps older rows deleted, and a reader of an older version sees what it saw."""
    s = S.Store(spark, str(tmp_path / "kb"), buckets=2)
    t = s.begin()
    t.append("docs", rows(spark, [(i, "a") for i in range(300)]), "doc_id")
    t.commit()
    for i in range(5):
        t = s.begin()
        t.upsert("docs", rows(spark, [(i, f"b{i}"), (i + 1, f"b{i}")]), "doc_id")
        t.commit()
    held, want = s.record(), state(s)
    assert s.compact("docs", least=2) and state(s) == want and state(s, record=held) == want
    assert [x["rows"] for x in s.record()["tables"]["docs"]["segments"]] == [300, 6]
    t = s.begin()
    t.append("docs", rows(spark, [(1000, "z")]), "doc_id")
    t.commit()
    assert state(s) == sorted([*want, (1000, "z")])


def test_writers_that_meet(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "kb"), buckets=2)
    t = s.begin()
    t.append("docs", rows(spark, [(1, "a"), (2, "b"), (3, "c")]), "doc_id")
    t.append("chunks", rows(spark, [(1, "a0"), (2, "b0")]), "doc_id")
    t.commit(name="x")
    slow, other = s.begin(), s.begin()
    slow.upsert("docs", rows(spark, [(1, "A"), (2, "B")]), "doc_id")
    slow.upsert("chunks", rows(spark, [(1, "A0"), (2, "B0")]), "doc_id")
    other.append("docs", rows(spark, [(4, "d")]), "doc_id")
    other.commit(seen=1)
    gone = s.begin()
    gone.delete("docs", rows(spark, [(2, "")]), "doc_id")
    gone.delete("chunks", rows(spark, [(2, "")]), "doc_id")
    gone.commit()
    strict = s.begin()
    strict.base = slow.base
    strict.upsert("docs", rows(spark, [(2, "B")]), "doc_id")
    with pytest.raises(S.Conflict):
        strict.commit()
    slow.commit(drop_changed=True, built=1)
    assert state(s) == [(1, "A"), (3, "c"), (4, "d")] and state(s, "chunks") == [(1, "A0")]
    assert s.meta == {"name": "x", "seen": 1, "built": 1}
    late, full = s.begin(), s.begin()
    full.replace("docs", rows(spark, [(1, "R"), (3, "R"), (4, "R")]), "doc_id")
    late.append("docs", rows(spark, [(5, "e")]), "doc_id")
    late.commit()
    full.commit(drop_changed=True)
    assert state(s) == [(1, "R"), (3, "R"), (4, "R"), (5, "e")]
    again, full = s.begin(), s.begin()
    full.replace("docs", rows(spark, [(9, "R")]), "doc_id")
    full.commit()
    again.upsert("docs", rows(spark, [(1, "old")]), "doc_id")
    with pytest.raises(S.Conflict):
        again.commit(drop_changed=True)
    assert state(s) == [(9, "R")]


def test_a_record_is_created_once(spark, tmp_path):
    path = str(tmp_path / "commits" / "1")
    said, start = [], threading.Barrier(6)
    S.write_file(spark, str(tmp_path / "commits" / "0"), "x")

    def write(i):
        start.wait()
        if S.created(spark, path, f"writer {i}"):
            said.append(i)

    threads = [InheritableThread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert len(said) == 1 and S.read_file(spark, path) == f"writer {said[0]}"


def test_many_writers_lose_nothing(spark, tmp_path):
    s, failed = S.Store(spark, str(tmp_path / "kb"), buckets=2), []

    def write(i):
        try:
            for j in range(3):
                t = S.Store(spark, s.root, 2).begin()
                t.append("docs", rows(spark, [(10 * i + j, "x")]), "doc_id")
                t.commit()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [InheritableThread(target=write, args=(i,)) for i in (1, 2, 3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(180)
    assert not failed and [k for k, _ in state(s)] == [10 * i + j for i in (1, 2, 3) for j in range(3)]
