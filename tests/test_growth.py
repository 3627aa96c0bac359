"""What must not grow faster than the input: shuffles, Python calls and batches."""

from pyspark.sql import functions as F

from lorespark.engine import KnowledgeBase
from lorespark.operators import embed, inverted
from lorespark.operators.chunking import Config
from lorespark.sources.store import Store, bucket_of


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "Reused" not in line for line in plan.split("\n"))


def test_build_shuffles_neither_vectors_nor_words(spark, tmp_path, monkeypatch):
    """chunks with vectors, texts and blocks are written where they are made; look-ups still find their buckets."""
    written, inner = {}, Store.write

    def write(self, name, rows, key, dealt=None):
        written.setdefault(name, []).append((exchanges(rows), dealt))
        return inner(self, name, rows, key, dealt)

    monkeypatch.setattr(Store, "write", write)
    kb = KnowledgeBase(spark, str(tmp_path), embed.bigram_embedder)
    c = kb.create("Growth")
    files = spark.createDataFrame([(f"f{i % 50}.md", bytearray(f"# Part {i}\n\nwords of text {i}".encode())) for i in range(60)], "name string, content binary")
    kb.add(c, files)
    kb.build(c, Config("heading", 60, 8, 1))
    assert written["chunks"] == [(0, "ordered")] and written["documents"][0] == (0, "ordered")
    assert [n for n, how in written[inverted.POSTINGS]] == [1] and written[inverted.POSTINGS][0][1] == "sorted"
    ids = [r["doc_id"] for r in kb.documents(c).collect()]
    assert len(set(ids)) == 60 and {r["name"] for r in kb.documents(c).collect()} == {f"f{i}.md" for i in range(50)}
    assert all(kb.chunk_count(c, d) == 1 for d in ids[:5])
    store = kb._store(c)
    assert store.read("chunks", keys=ids).count() == 60 and store._files("chunks", store.record()["tables"]["chunks"]["segments"], kb.chunks(c).schema).where(F.col("_bucket") != bucket_of("doc_id", store.buckets)).count() == 0
    assert kb.search("text 7", c, min_score=0.0)["ok"]


def test_walk_opens_levels_in_one_pass(spark, monkeypatch):
    """leaves of shallow trees are written once, whatever the depth that is asked for."""
    import json

    from lorespark.operators import json_tree
    from lorespark.sources import snapshots
    from test_indexes import leaves

    kept, passes = snapshots.kept, []
    monkeypatch.setattr(snapshots, "kept", lambda df, name: (passes.append(name), kept(df, name))[1])
    deep = 1
    for i in range(7):
        deep = {"d": [deep]} if i % 2 else {"e": deep}
    values = [{"a": 1, "b": {"c": [True, None, {"d": "x"}], "f": {}}}, [], "text", deep, [[[[[]]]]], None]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(50, "{broken")], "id long, j string")
    for depth in (0, 4, 5, 9, 32):
        got = sorted((tuple(r) for r in json_tree.walk(rows, "id", "j", depth).collect()), key=str)
        assert got == sorted(((i, *x) for i, v in enumerate(values) for x in leaves(v, most=depth)), key=str)
    passes.clear()
    assert json_tree.walk(rows.where("id < 3"), "id", "j").count() == 7 and len(passes) == 1


def test_stream_calls_python_by_group(spark, tmp_path, monkeypatch):
    """digests are read and written by group, not by document; edits, repeats and returns to an older text come out as before."""
    from lorespark.streaming import state

    monkeypatch.setattr(state, "GROUPS", 3)
    source, where = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        rows.write.mode("append").parquet(source)
        found = state.run_to_end(state.changed_documents(spark.readStream.schema("doc_id long, text string").parquet(source)), where, "append")
        last = found.agg(F.max("_batch")).first()[0]
        return found, {r["doc_id"]: r["text"] for r in found.where(F.col("_batch") == last).collect()}

    docs = lambda text: spark.range(-20, 20).select(F.col("id").alias("doc_id"), text.alias("text"))
    first, second = F.when(F.col("id") != 7, F.concat(F.lit("a"), "id")), F.when(F.col("id") % 4 == 0, "b").when(F.col("id") != 7, F.concat(F.lit("a"), "id"))
    assert run(docs(first).unionByName(docs(first)))[1] == {i: None if i == 7 else f"a{i}" for i in range(-20, 20)}
    found, got = run(docs(second))
    assert got == {i: "b" for i in range(-20, 20, 4)}
    assert run(docs(first))[1] == {i: f"a{i}" for i in range(-20, 20, 4)}
    kept = spark.read.format("statestore").option("stateVarName", "digests").load(f"{where}/state")
    assert kept.count() <= 3


def test_windows_of_strings_come_from_one_scan(spark, monkeypatch):
    """no array is cut and joined for each character."""
    from lorespark.operators import lexicon
    from lorespark.sources import snapshots

    kept, plans = snapshots.kept, {}
    monkeypatch.setattr(snapshots, "kept", lambda df, name: (plans.update({name: df._jdf.queryExecution().analyzed().toString()}), kept(df, name))[1])
    got = {r["gram"]: r["n"] for r in lexicon.grams(spark.createDataFrame([("a𠀀b𠀀",), ("b",), ("",), (None,)], "run string"), 3).collect()}
    assert got == {"a": 1, "𠀀": 2, "b": 2, "a𠀀": 1, "𠀀b": 1, "b𠀀": 1, "a𠀀b": 1, "𠀀b𠀀": 1}
    assert "slice(" not in plans["grams"] and "lambda" not in plans["grams"]


def test_chunks_leave_python_in_small_batches(spark):
    """a task gives chunks as it cuts them, not all of a batch of documents at once."""
    from lorespark.operators import chunking

    docs = spark.range(40).selectExpr("if(id = 3, null, id) AS doc_id", "if(id = 4, null, repeat('word and more. ', 4000)) AS text").coalesce(1)
    chunks = chunking.chunk_documents(docs, chunking.Config("fixed", 500, 0, 1))
    assert "MapInArrow" in chunks._jdf.queryExecution().executedPlan().toString() and "MapInPandas" not in chunks._jdf.queryExecution().executedPlan().toString()
    rows = chunks.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {i if i != 3 else None: 60_000 for i in range(40) if i != 4}


def test_product_codes_are_read_once_made(spark):
    """a search scans stored codes; making them isn't repeated for each block of queries, nor in the task that scans."""
    import numpy as np

    from lorespark.operators import product_codes

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))], "id long, vector array<double>")
    book = product_codes.fit(rows, subspaces=4, codes=16)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    found = product_codes.candidates(product_codes.coded(rows, book), book, asked, 5)
    assert sum("MapInArrow" in line for line in found._jdf.queryExecution().analyzed().toString().split("\n")) == 1
    assert {r["query_id"]: r["count"] for r in found.groupBy("query_id").count().collect()} == {i: 5 for i in range(0, 300, 20)}
