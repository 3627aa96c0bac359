"""Graph, product codes, filtered search, JSON trees, progress."""

import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespark.engine import KnowledgeBase
from lorespark.operators import embed, graph_index, inverted, json_tree, product_codes, retrieval
from lorespark.operators.chunking import Config


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 24))
    x[17] = x[18] = x[19]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(5000, [0.0] * 24), (5001, None), (5002, [float("nan")] * 24), (5003, [1.0] * 5)]
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(4).cache()


def pairs(df):
    return {(r["query_id"], r["id"]) for r in df.select("query_id", "id").collect()}


def test_graph(spark, clustered):
    asked = clustered.where("id % 100 = 0 and id < 3000 or id = 19").select(F.col("id").alias("query_id"), "vector")
    graph = graph_index.build(clustered, degree=10, rounds=5)
    hits, work = graph_index.search(graph, asked, 8, effort=32, width=8)
    exact, got = pairs(retrieval.dense(clustered.where("id < 3000"), asked, 8)), pairs(hits)
    share = work.agg(F.avg("scored")).first()[0] / 3000
    print(f"recall {len(got & exact) / len(exact):.3f}, share {share:.3f}")
    assert len(got & exact) >= 0.9 * len(exact) and share < 0.25
    assert {17, 18, 19} <= {i for q, i in got if q == 19}
    scores = hits.where("query_id = 19").orderBy("rank").collect()
    assert [r["rank"] for r in scores] == list(range(1, 9)) and scores[0]["score"] == pytest.approx(1.0, abs=1e-5)
    assert graph.edges.agg(F.max(F.size("neighbours"))).first()[0] <= 20
    empty = graph_index.build(clustered.limit(0))
    assert graph_index.search(empty, asked, 3)[0].count() == 0


def test_product_codes(spark, clustered):
    asked = clustered.where("id % 60 = 0 and id < 3000").select(F.col("id").alias("query_id"), "vector")
    book = product_codes.fit(clustered.where("id <> 5003"), subspaces=6)
    codes = product_codes.coded(clustered.where("id <> 5003"), book)
    assert codes.agg(F.max(F.length("codes"))).first()[0] == 6 and codes.count() == 3000
    got, exact = pairs(product_codes.search(clustered, codes, book, asked, 8)), pairs(retrieval.dense(clustered.where("id < 3000"), asked, 8))
    print(f"recall {len(got & exact) / len(exact):.3f}")
    assert len(got & exact) >= 0.9 * len(exact)
    #: Table sums are inner products with what the codes stand for.
    one = asked.where("query_id = 60").first()["vector"]
    q = np.asarray(one, np.float32) / np.linalg.norm(one)
    held = {r["id"]: np.concatenate([book[s, c] for s, c in enumerate(r["codes"])]) for r in codes.where("id < 50").collect()}
    near = {r["id"]: r["near"] for r in product_codes.candidates(codes.where("id < 50"), book, asked.where("query_id = 60"), 50).collect()}
    assert near.keys() == held.keys() and all(near[i] == pytest.approx(float(held[i] @ q), abs=1e-4) for i in near)


def files(spark, rows):
    return spark.createDataFrame([(n, bytearray(c.encode())) for n, c in rows], "name string, content binary")


def test_filtered_search(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path), embed.bigram_embedder)
    c = kb.create("Filtered")
    kb.add(c, files(spark, [(f"f{i}.md", f"# Part {i}\n\nwords of text number {i} and some {'more ' * (i % 5)}") for i in range(30)]))
    kb.build(c, Config("heading", 60, 8, 1))
    docs = {r["name"]: r["doc_id"] for r in kb.documents(c).select("name", "doc_id").collect()}
    some = [docs[f"f{i}.md"] for i in (3, 4, 11)]
    hits, _ = kb.hits(c, "text number more", doc_ids=some, topk=50, min_score=0.0)
    got = [(r["doc_id"], round(r["score"], 6)) for r in hits.collect()]
    chunks = kb.chunks(c).where(F.col("doc_id").isin(some))
    q = spark.createDataFrame([(0, kb.embed_query("text number more"))], "query_id long, vector array<double>")
    want = {(r["id"], round(r["score"], 6)) for r in retrieval.dense(chunks.select(F.col("chunk_id").alias("id"), "vector"), q, 50).collect()}
    assert {(r["id"], round(r["score"], 6)) for r in hits.collect()} == want and {d for d, _ in got} == set(some)
    words = inverted.search(kb._store(c), spark.createDataFrame([(0, "text number more")], "query_id long, text string"), 50)
    narrow = inverted.search(kb._store(c), spark.createDataFrame([(0, "text number more")], "query_id long, text string"), 50, owners=some)
    assert sorted((r["id"], r["score"]) for r in narrow.collect()) == sorted((r["id"], r["score"]) for r in words.collect() if r["id"].split("#")[0] in some)
    opened = kb._store(c).read("chunks", keys=some)
    assert len({r[0] for r in opened.select(F.input_file_name()).distinct().collect()}) <= 3 < len({r[0] for r in kb.chunks(c).select(F.input_file_name()).distinct().collect()})


def test_progress_never_falls(spark, tmp_path):
    def slow(texts):
        time.sleep(0.2)
        return embed.bigram_embedder(texts)

    kb = KnowledgeBase(spark, str(tmp_path), slow)
    c = kb.create("Slow")
    kb.add(c, files(spark, [(f"f{i}.md", f"# Part {i}\n\nwords {i}") for i in range(40)]).repartition(8))
    kb.start_build(c, Config("heading", 60, 8, 1))
    seen = []
    while (now := kb.build_status(c))["running"]:
        seen.append(now["fraction"])
        time.sleep(0.05)
    done = kb.wait_for_build(c, 120)
    assert seen == sorted(seen) and max(seen) <= 0.99 and len({round(x, 3) for x in seen}) >= 3
    assert done["ok"] and done["fraction"] == 1.0 and done["documents"] == 40 and done["chunks"] == 40


def leaves(v, path="", depth=0, most=32):
    if isinstance(v, dict) and v:
        if depth > most:
            return [(path, "too_deep", json.dumps(v, separators=(",", ":")))]
        return [x for k in v for x in leaves(v[k], f"{path}.{k}" if path else k, depth + 1, most)]
    if isinstance(v, list) and v:
        if depth > most:
            return [(path, "too_deep", json.dumps(v, separators=(",", ":")))]
        return [x for i, e in enumerate(v) for x in leaves(e, f"{path}[{i}]", depth + 1, most)]
    if isinstance(v, (dict, list)):
        return [(path, "empty_object" if isinstance(v, dict) else "empty_array", None)]
    return [(path, "scalar", None if v is None else v if isinstance(v, str) else json.dumps(v))]


def test_json_trees(spark):
    deep = 1
    for _ in range(40):
        deep = {"d": [deep]} if _ % 2 else {"e": deep}
    values = [{"a": 1, "b": {"c": [True, None, {"d": "x", "e": []}], "f": {}}}, [1, [2, [3, {"k": "v"}]]], "text", 5, None, {}, [], deep, {"": {"é.x": 1.5}}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(50, "{broken"), (51, None), (0, json.dumps(values[0]))]
    got = json_tree.walk(spark.createDataFrame(rows, "id long, j string"), "id", "j").collect()
    want = sorted([(i, *x) for i, v in enumerate(values) for x in leaves(v)] + [(0, *x) for x in leaves(values[0])], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want
