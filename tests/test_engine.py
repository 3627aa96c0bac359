import pytest
from pyspark.sql import functions as F

from lorespark.engine import KnowledgeBase, effective, validated
from lorespark.functions import text as T
from lorespark.operators import embed
from lorespark.operators.chunking import Config

CONFIG = Config("heading", 60, 8, 1)


def files(spark, rows):
    return spark.createDataFrame([(n, bytearray(c.encode())) for n, c in rows], "name string, content binary")


def test_settings():
    assert effective({"topk": 3}, {"topk": 5, "min_score": 0.1})["topk"] == 3 and effective({}, {"min_score": 0.1})["min_score"] == 0.1
    for bad in ({"topk": 0}, {"min_score": 1.5}, {"mode": "x"}, {"other": 1}):
        with pytest.raises(ValueError):
            validated(bad)


def test_life_of_a_collection(spark, tmp_path):
    asked = []

    def embedder(texts):
        asked.extend(texts)
        return embed.bigram_embedder(texts)

    kb = KnowledgeBase(spark, str(tmp_path), embed.bigram_embedder, quota=100_000)
    c = kb.create("Agent Book")
    assert spark.range(1).select(T.is_collection_id(F.lit(c))).first()[0] and kb.ids() == [c]
    with pytest.raises(ValueError):
        kb.create("Agent Book")
    assert kb.search("  ")["reason"] == "invalid_argument" and kb.search("x")["reason"] == "discovery_needed"
    got = kb.add(c, files(spark, [("a.md", "# Retrieval\r\n\r\nDense vectors and words are fused by rank."), ("b.html", "<h1>Cooking</h1><p>Boil the pasta in salted water."), ("c.exe", "x"), ("d.docx", "broken")]))
    assert {r["name"]: r["reason"] for r in got.collect()} == {"a.md": None, "b.html": None, "c.exe": "unsupported file type", "d.docx": None}
    assert kb.search("x", c)["reason"] == "empty_result"
    assert kb.build(c, CONFIG)["mode"] == "full"
    assert {r["name"]: r["status"] for r in kb.documents(c).collect()} == {"a.md": "ready", "b.html": "ready", "d.docx": "failed"}
    found = kb.search("boil pasta in water", min_score=0.2)
    assert found["ok"] and found["hits"][0]["name"] == "b.html" and found["hits"][0]["line"] == 1
    assert kb.search("x", "agent")["ok"] in (True, False) and kb.search("x", "other")["reason"] == "collection_not_found"
    assert kb.build(c, CONFIG)["mode"] == "none"

    kb.embedder = embedder
    kb.add(c, files(spark, [("e.md", "# Gardens\n\nRoses need sun.")]))
    assert kb.build(c, CONFIG) | {"reason": ""} == {"mode": "incremental", "reason": "", "documents": 1, "chunks": 3}
    assert kb.build(c, Config("fixed", 60, 8, 1))["reason"] == "chunking has changed"
    kb.set_settings(c, topk=1, min_score=0.0)
    assert len(kb.search("roses", c)["hits"]) == 1
    doc = kb.documents(c).where("name = 'e.md'").first()["doc_id"]
    address = spark.range(1).select(T.citation_address(F.lit(c), F.lit(doc), F.lit(3))).first()[0]
    assert [(r["line"], r["is_cited"]) for r in kb.citation(address, 1).collect()] == [(2, False), (3, True)]
    assert kb.citation("kb://no") is None
    kb.remove(c, [doc])
    assert kb.documents(c).count() == 3 and not any(h["name"] == "e.md" for h in kb.search("roses", c, topk=50)["hits"])
    over = kb.add(c, files(spark, [("big.txt", "x" * 200_000)])).first()["reason"]
    assert over.startswith("over the quota")
    assert kb.overview().first()["status"] == "failed"
    kb.rename(c, "Other")
    assert kb.collections().first()["name"] == "Other"
    kb.delete(c)
    assert kb.ids() == []


def test_builds_in_the_background_and_reports(spark, tmp_path):
    import threading

    kb = KnowledgeBase(spark, str(tmp_path), embed.bigram_embedder)
    c = kb.create("Night Shift")
    kb.add(c, files(spark, [("a.md", "# One\n\nAlpha text here."), ("b.html", "<h1>Two</h1><p>Beta text.")]))
    assert kb.build_plan(c, CONFIG)["mode"] == "full" and kb.build_plan(c, CONFIG)["documents"] == 2 and kb.stored_strategy(c) is None
    assert kb.build_status(c) == {} and kb.cancel_build(c) is False
    assert kb.estimate_cost(c, CONFIG).first()["chunks"] == 2 and kb.embedding_info()["dimension"] == embed.DIMENSION
    assert {o["value"]: o["compression"] for o in kb.quantizer_options()} == {"none": 1, "FP16": 2, "INT8": 4, "INT4": 8}

    gate = threading.Event()
    work, kb.build = kb.build, lambda *a: (gate.wait(60), work(*a))[1]
    assert kb.start_build(c, CONFIG) is True and kb.start_build(c, CONFIG) is False
    gate.set()
    done = kb.wait_for_build(c, 120)
    kb.build = work
    assert done["ok"] is True and done["running"] is False and done["result"]["chunks"] == 2
    assert kb.stored_strategy(c)["chunking"]["chunk_tokens"] == 60 and kb.build_plan(c, CONFIG) == {"mode": "incremental", "reason": "unchanged", "documents": 0, "bytes": 0}
    assert [r["name"] for r in kb.list_documents(c, "ready", "A.M").collect()] == ["a.md"] and "text" not in kb.list_documents(c).columns
    doc = kb.documents(c).where("name = 'a.md'").first()["doc_id"]
    assert kb.chunk_count(c, doc) == 1 and kb.chunk_count(c, "doc_none") == 0
    assert kb.builds().first()["collection"] == c and "full build" in kb.log(c).collect()[-1]["message"]
    found = kb.retrieve(c, "beta text")
    assert len(found["hits"]) == 2 and found["version"] == 1 and found["hits"][0]["name"] == "b.html"
    report = kb.inspect().first()
    assert (report["documents"], report["served"], report["difference"], report["not_served"]) == (2, 2, 0, 0) and report["disk_bytes"] > 0
    assert kb.reparse_all(c, CONFIG)["mode"] == "full" and kb.documents(c).where("status = 'ready'").count() == 2

    kb.embedder = lambda texts: (_ for _ in ()).throw(ValueError("Collection is closed"))
    kb.start_build(c, CONFIG, True)
    failed = kb.wait_for_build(c, 120)
    assert failed["ok"] is False and failed["error"].startswith("the index was closed") and kb.log(c).collect()[-1]["level"] == "error"
    tight = KnowledgeBase(spark, str(tmp_path), embed.bigram_embedder, quota=1000)
    assert tight.build(c, CONFIG, True)["mode"] == "refused"


def test_an_upload_inside_a_build_stays(spark, tmp_path):
    """What is uploaded or removed while a build runs is neither lost nor brought back."""
    made = []

    kb = KnowledgeBase(spark, str(tmp_path), embed.bigram_embedder)
    c = kb.create("Busy")
    kb.add(c, files(spark, [("a.md", "# A\n\nAlpha text."), ("b.md", "# B\n\nBeta text.")]))
    ids = {r["name"]: r["doc_id"] for r in kb.documents(c).collect()}
    wanted = kb._wanted

    def meanwhile(docs, config):
        if not made:
            made.append(1)
            kb.add(c, files(spark, [("c.md", "# C\n\nGamma text.")]))
            kb.remove(c, [ids["b.md"]])
        return wanted(docs, config)

    kb._wanted = meanwhile
    assert kb.build(c, CONFIG)["mode"] == "full"
    kb._wanted = wanted
    assert {r["name"]: r["status"] for r in kb.documents(c).collect()} == {"a.md": "ready", "c.md": "pending"}
    assert [r["doc_id"] for r in kb.chunks(c).select("doc_id").distinct().collect()] == [ids["a.md"]]
    assert kb.build(c, CONFIG)["documents"] == 1 and kb.documents(c).where("status = 'ready'").count() == 2
    assert kb.chunks(c).select("doc_id").distinct().count() == 2


def test_files_of_one_name(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path), embed.bigram_embedder)
    c = kb.create("Twice")
    got = kb.add(c, files(spark, [("a.md", "first"), ("a.md", "second"), ("d/a.html", "<p>third</p>")])).collect()
    assert len({r["doc_id"] for r in got}) == 3 and {r["reason"] for r in got} == {None}
    docs = kb.documents(c).collect()
    assert sorted(r["text"].strip() for r in docs) == ["first", "second", "third"] and {r["doc_id"] for r in docs} == {r["doc_id"] for r in got}


def test_text_over_the_quota_fails_alone(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path), embed.bigram_embedder, quota=2000)
    c = kb.create("Tight")
    rows = ",".join(["x"] * 60)
    kb.add(c, files(spark, [("small.txt", "fits"), ("wide.csv", "\n".join([rows] * 12))]))
    found = {r["name"]: (r["status"], r["error"]) for r in kb.documents(c).collect()}
    assert found["small.txt"][0] == "pending" and found["wide.csv"] == ("failed", "its text is over the quota")


def test_names_that_share_a_hash(spark, tmp_path, monkeypatch):
    """Names whose hashes meet are documents of their own, in one upload and in later ones; each keeps its text and its chunks."""
    from lorespark.functions import text as T

    whole = T.fnv1a_id
    monkeypatch.setattr(T, "fnv1a_id", lambda name, seed: F.concat(F.lit("doc_0000000"), F.right(whole(name, seed), F.lit(1))) if isinstance(name, str) else whole(name, seed))
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    c = kb.create("Shared")
    for start in (0, 40):
        kb.add(c, spark.createDataFrame([(f"n{i}.md", f"# T\n\nwords of number {i} for a chunk".encode()) for i in range(start, start + 40)], "name string, content binary"))
        kb.build(c, Config("fixed", 512, 0, 1))
    docs = kb.documents(c).collect()
    assert len(docs) == len({d["doc_id"] for d in docs}) == 80 and all(f"number {d['name'][1:-3]} for" in d["text"] for d in docs)
    chunks = kb.chunks(c).collect()
    assert len(chunks) == 80 and {k["doc_id"] for k in chunks} == {d["doc_id"] for d in docs} and len({k["chunk_id"] for k in chunks}) == 80
