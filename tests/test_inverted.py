"""The stored index against the scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import inverted, retrieval
from lorespark.sources.store import Store


def frame(spark, rows):
    return spark.createDataFrame([(i, i // 3, t) for i, t in rows], "id long, owner long, text string")


def listed(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Straße", "知識庫"]
    say = lambda: " ".join(words[min(len(words) - 1, int(rng.paretovariate(0.6)) - 1)] for _ in range(rng.randint(0, 40)))
    return {i: say() for i in range(900)} | {900: None, 901: ""}


@pytest.mark.parametrize("k", [1, 7, 40])
def test_same_rows_as_the_scan(spark, tmp_path_factory, corpus, k):
    store = Store(spark, str(tmp_path_factory.mktemp("index")), buckets=4)
    queries = spark.createDataFrame([(0, "w0 w1 w5"), (1, "w40 w41"), (2, "w59"), (3, "none of these"), (4, ""), (5, "straße 知識庫 w0"), (6, None)], "query_id long, text string")
    t = store.begin()
    inverted.update(t, frame(spark, [(i, x) for i, x in corpus.items() if i % 5]), 1)
    t.commit()
    live = {i: x for i, x in corpus.items() if i % 5}
    check = lambda: listed(inverted.search(store, queries, k, first=2)) == listed(retrieval.bm25(frame(spark, list(live.items())).select("id", "text"), queries, k))
    assert check()
    #: Owners 0 to 49 come with other texts, and what was left out at first comes too.
    fresh = {i: (x or "") + " w1 w59" for i, x in corpus.items() if i < 150} | {i: x for i, x in corpus.items() if i % 5 == 0 and i >= 150}
    t = store.begin()
    held = store.record()
    gone = {i: x for i, x in live.items() if i < 150}
    inverted.update(t, frame(spark, list(fresh.items())), 2, frame(spark, list(gone.items())), frame(spark, list(gone.items())))
    t.commit()
    before = listed(retrieval.bm25(frame(spark, list(live.items())).select("id", "text"), queries, k))
    live = live | fresh
    assert check() and listed(inverted.search(store, queries, k, held, first=2)) == before
    t = store.begin()
    gone = {i: live.pop(i) for i in list(live) if i // 3 in (7, 100, 200)}
    inverted.forget(t, frame(spark, list(gone.items())), 3)
    t.commit()
    assert check()


def test_reads_its_terms_buckets_and_skips_spans(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=64)
    rows = [(i, "common " * (1 + (i % 500 == 0) * 30) + f"name{i}") for i in range(8000)]
    t = store.begin()
    inverted.update(t, frame(spark, rows), 1)
    t.commit()
    read = store.read(inverted.POSTINGS, keys=["common", "name7"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [In(term" in plan
    files = {r[0] for r in read.select(F.input_file_name()).distinct().collect()}
    assert len({f.split("_bucket=")[1].split("/")[0] for f in files}) <= 2
    scored = []
    inner = inverted._scores
    try:
        inverted._scores = lambda found, *a: (scored.append(found), inner(found, *a))[1]
        got = inverted.search(store, spark.createDataFrame([(0, "common")], "query_id long, text string"), 5, first=16).collect()
    finally:
        inverted._scores = inner
    assert len(got) == 5 and {r["id"] % 500 for r in got} == {0}
    assert sum(x.count() for x in scored) == 16 and read.where("term = 'common'").count() == 63


def test_many_queries_read_each_block_once(spark, tmp_path, corpus, monkeypatch):
    """Queries of many terms are summed up by blocks of documents, after changes and removals: the rows of the scan, without a row for each query and document."""
    store = Store(spark, str(tmp_path), buckets=4)
    rng = random.Random(9)
    queries = spark.createDataFrame([(i, " ".join(rng.choice(["w0", "w1", "w9", "知識庫", "none"]) for _ in range(3))) for i in range(40)], "query_id long, text string")
    live = {i: x for i, x in corpus.items() if i % 5}
    fresh = {i: (x or "") + " w1 w9" for i, x in live.items() if i < 150}
    for number, (rows, gone) in enumerate([(live, None), (fresh, {i: live[i] for i in fresh})], 1):
        t = store.begin()
        inverted.update(t, frame(spark, list(rows.items())), number, None if gone is None else frame(spark, list(gone.items())), None if gone is None else frame(spark, list(gone.items())))
        t.commit()
    live |= fresh
    want = listed(retrieval.bm25(frame(spark, list(live.items())).select("id", "text"), queries, 7))
    for size in (100, 10_000):
        for name in ("ROW_BLOCK", "SHARE_BLOCK", "MAX_QUERIES"):
            monkeypatch.setattr(retrieval, name, size)
        found = inverted.search(store, queries, 7)
        assert listed(found) == want and "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_shares_are_dealt_once_for_many_queries(spark, tmp_path, corpus, monkeypatch):
    """More queries than one block holds don't copy the shares, unless their hits ask for it; the rows are those of the scan."""
    from lorespark.operators import blocks

    dealt, best = [], blocks.best_sums
    monkeypatch.setattr(blocks, "best_sums", lambda shares, terms, n, m, k: dealt.append(m) or best(shares, terms, n, m, k))
    for name, n in (("FEW", 0), ("MAX_QUERIES", 8)):
        monkeypatch.setattr(retrieval, name, n)
    monkeypatch.setattr(inverted, "MAX_QUERIES", 8)
    store, docs = Store(spark, str(tmp_path), buckets=4), frame(spark, list(corpus.items()))
    t = store.begin()
    inverted.update(t, docs, 1)
    t.commit()
    gone = docs.where("owner < 40")
    t = store.begin()
    inverted.forget(t, gone, 2)
    t.commit()
    queries = spark.createDataFrame([(i, f"w{i % 60} w{i % 7} none{i}") for i in range(24)], "query_id long, text string")
    want = listed(retrieval.bm25(docs.where("owner >= 40").select("id", "text"), queries, 5))
    dealt.clear()
    assert listed(inverted.search(store, queries, 5)) == want and dealt == [1]
    monkeypatch.setattr(retrieval, "HIT_BLOCK", 60)
    assert listed(inverted.search(store, queries, 5)) == want and dealt == [1, 2]
