import random

from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import embed, retrieval, vector_index


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, score double, rank long")


def test_scores_and_bands(spark):
    d = spark.createDataFrame([(0.0,), (0.2,), (1.5,), (-0.3,), (None,), (float("nan"),), (float("inf"),)], "d double")
    assert [r[0] for r in d.select(T.match_score("d")).collect()] == [1.0, 0.8, 0.0, 1.0, 0.0, 0.0, 0.0]
    s = spark.createDataFrame([(0.85,), (0.84,), (0.70,), (0.55,), (0.54,)], "s double")
    assert [r[0] for r in s.select(T.confidence_band("s")).collect()] == ["strong", "relevant", "relevant", "fair", "low"]


def test_fusion_orders_and_never_scores(spark):
    dense = hits(spark, [(0, 1, 0.63, 1), (0, 2, 0.64, 2)])
    fts = hits(spark, [(0, 9, 7.5, 1), (0, 1, 3.0, 2)])
    got = {r["id"]: r for r in retrieval.fuse(dense, fts).collect()}
    assert got[9]["score"] == 0.2 and got[9]["dense_rank"] is None and got[1]["score"] == 0.63
    assert abs(got[1]["rrf"] - (1 / 61 + 1 / 62)) < 1e-12


def test_floor_before_cap_and_stats(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)], "apple pie" if i == 3 else "plain") for i in range(6)], "id long, vector array<double>, text string")
    q = spark.createDataFrame([(0, [1.0, 0.0], "apple")], "query_id long, vector array<double>, text string")
    got = retrieval.hybrid(vectors, q, topk=2, min_score=0.4).orderBy("rank").collect()
    assert [r["id"] for r in got] == [0, 1] and got[0]["score"] == 1.0
    stats = retrieval.search_stats(vectors, q, min_score=0.4).first()
    assert stats["mode"] == "hybrid" and stats["below_floor"] == 3 and stats["fts_only_hits"] == 0
    none = q.withColumn("text", F.lit("?!"))
    assert retrieval.search_stats(vectors, none, min_score=0.4).first()["mode"] == "dense"


def test_wide_words_are_paired(spark):
    rows = spark.createDataFrame([("知识库 Search 中",)], "t string").select(T.search_tokens("t")).first()[0]
    assert rows == ["知识", "识库", "search", "中"]


def test_quantized_recall(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.where("id < 10").select(F.col("id").alias("query_id"), "vector")
    pick = lambda d: {(r["query_id"], r["id"]) for r in d.collect()}
    assert len(pick(vector_index.rescored(v, q, 5)) & pick(retrieval.dense(v, q, 5))) >= 48


def test_embedders_agree(spark):
    docs = spark.createDataFrame([(1, "abca é"), (2, ""), (3, "x")], "doc_id long, text string")
    sparse = {}
    for r in embed.bigram_buckets(docs).collect():
        sparse[r["doc_id"]] = dict(zip(r["buckets"], r["counts"]))
    for i, t in ((1, "abca é"), (3, "x")):
        v = embed.bigram_vector(t)
        n = sum(x * x for x in sparse[i].values()) ** 0.5
        assert {b: round(float(v[b]), 5) for b in v.nonzero()[0]} == {b: round(c / n, 5) for b, c in sparse[i].items()}
    asked = []
    out = embed.embedded(docs, embed.bigram_embedder, 1024).collect()
    assert len(out) == 3 and len(out[0]["vector"]) == 1024
    assert embed.seated(2, [{"index": 1, "embedding": "b"}, {"index": 0, "embedding": "a"}]) == ["a", "b"]
    assert embed.seated(2, [{"index": 1, "embedding": "b"}, {"index": 1, "embedding": "a"}]) == ["b", "a"]

    def flaky():
        asked.append(1)
        if len(asked) < 3:
            raise TimeoutError
        return "ok"

    assert embed.with_retry(flaky, sleep=lambda s: None) == "ok"


def test_many_queries_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = "apple pie plum tart fig cake".split()
    rows = [(i, [rng.gauss(0, 1) for _ in range(3 + i % 2)], " ".join(rng.choice(words) for _ in range(6))) for i in range(90)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, text string")
    q = v.where("id % 2 = 0 or id < 9").select(F.col("id").alias("query_id"), "vector", F.substring("text", 1, 8).alias("text"))
    model = vector_index.fit_cells(v.where("id % 2 = 0"), lists=4)
    cells = vector_index.celled(v.where("id % 2 = 0"), model)
    asked = {
        "dense": lambda: retrieval.dense(v, q, 7), "bm25": lambda: retrieval.bm25(v, q, 7), "hybrid": lambda: retrieval.hybrid(v, q, 7, 0.2), "rescored": lambda: vector_index.rescored(v, q, 7),
        "int4": lambda: vector_index.rescored(v, q, 7, "INT4"), "probed": lambda: vector_index.probed(cells, model, q.where("query_id % 2 = 0"), 7, 2),
    }
    rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())
    few = {name: rounded(ask()) for name, ask in asked.items()}
    monkeypatch.setattr(retrieval, "MAX_QUERIES", 10)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 20, raising=False)
    assert {name: rounded(ask()) for name, ask in asked.items()} == few and all(few.values())


def test_blocks_give_what_the_jvm_gives(spark, monkeypatch):
    """Scores by blocks: odd vectors, ties by id, ids that repeat, more blocks than one; no row for each pair is made."""
    rng = random.Random(6)
    words = "apple pie plum tart fig cake".split()
    odd = [None, [], [0.0] * 3, [float("nan"), 1.0, 0.0], [1.0, None, 0.0], [float("inf"), 1.0, 1.0], [1e200, 1e200, 0.0]]
    vectors = [rng.choice([[1.0, 2.0, 3.0], [rng.gauss(0, 1) for _ in range(3 + i % 2)]]) for i in range(110)] + odd
    rows = [(f"n{i % 113}", v, None if i % 10 == 9 else " ".join(rng.choice(words) for _ in range(1 + i % 7))) for i, v in enumerate(vectors)]
    v = spark.createDataFrame(rows, "id string, vector array<double>, text string").repartition(3)
    q = spark.createDataFrame([(i, x, t) for i, (_, x, t) in enumerate(rows) if i % 2 or i > 100], "query_id int, vector array<double>, text string").fillna("")
    #: Scores are compared to nine digits: sums may be taken in another order.
    shown = lambda df: sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.select(sorted(df.columns)).collect())
    ask = [lambda: retrieval.dense(v, q, 7), lambda: retrieval.dense(v, q, 1000), lambda: retrieval.bm25(v, q, 7), lambda: vector_index.rescored(v.where("exists(vector, x -> x > 0) and forall(vector, x -> x < 9)").dropDuplicates(["id"]), q, 3)]
    monkeypatch.setattr(retrieval, "FEW", 10_000)
    few = [shown(a()) for a in ask]
    for size in (20, 10_000):
        for name, n in (("FEW", 0), ("ROW_BLOCK", size), ("MAX_QUERIES", size), ("SHARE_BLOCK", 3 * size)):
            monkeypatch.setattr(retrieval, name, n)
        for a, want in zip(ask, few):
            got = shown(a())
            assert want and not set(got) ^ set(want) and len(got) == len(want), sorted(set(got) ^ set(want))[:12]
    plan = retrieval.dense(v, q, 7)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan.lower()


def test_more_queries_than_are_broadcast(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, vector array<double>")
    q = spark.range(retrieval.MAX_QUERIES + 1).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), (F.col("id") % 5).cast("double")).alias("vector"))
    got = retrieval.dense(v, q, 1)
    assert got.count() == retrieval.MAX_QUERIES + 1 and got.where("id <> query_id % 5").count() == 0


def test_searches_ask_with_every_twentieth_id(spark):
    from lorespark.plans import registry

    dir = "/root/testdata/sf0.001"
    want = {r[0] for r in registry.table(spark, dir, "embeddings").where("vec_id % 20 = 0").select("vec_id").collect()}
    for name in ("quantized_int4_topk", "quantized_fp16_topk", "cells_topk"):
        assert {r[0] for r in registry.queries()[name](spark, dir).select("query_id").distinct().collect()} == want, name


def test_text_search_that_fails(spark):
    """The search goes on by vectors alone and says so."""
    broken = F.when(F.col("id") >= 0, F.raise_error(F.lit("no index"))).otherwise(F.lit("x"))
    chunks = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, vector array<double>").withColumn("text", broken)
    asked = spark.createDataFrame([(0, [1.0, 1.0], "x y")], "query_id long, vector array<double>, text string")
    hits = retrieval.hybrid(chunks, asked, 3, 0.0).collect()
    assert len(hits) == 3 and all(r["fts_rank"] is None for r in hits)
    assert retrieval.search_stats(chunks, asked, 0.0).first()["mode"] == "dense"
