"""Null ids, clashing names and repeated rows through every operator and stage."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorespark.llm import bpe, ctph, near_dedup, packing, periodic, pii, quality, quality_rules, sharding, token_files

CLASHING = ["_text", "_row", "_score", "_task", "_all", "_new", "component", "kept", "spans", "shard", "slot", "bucket", "size", "length", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    text = "some clean words of a text that says a@b.c and 1.2.3.4 to all of its readers"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, None), (3, ""), (2**60 + 1, text + " once more"), (4, "x " * 4000)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def test_operators_keep_every_row(spark, docs, tmp_path):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    outs = [
        near_dedup.near_duplicates(docs), bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), 10), sharding.shard(docs, 3), ctph.fingerprints_and_edits(docs),
        token_files.read_documents(spark, token_files.write_shards(docs, str(tmp_path / "t"), vocabulary, 2)),
        pii.find_pii(docs), packing.pack(docs, vocabulary), quality.score_quality(docs, labels),
    ]
    want = sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    for out in outs:
        assert sorted(str(r["doc_id"]) for r in out.select("doc_id").collect()) == want


def test_stages_pass_other_columns(spark, docs):
    for stage in (lambda d: quality.accepted(d, None), lambda d: corpus_pipeline.near_dedup(spark, d, ""), pii.redact):
        out = stage(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[c] for c in CLASHING] == list(range(len(CLASHING)))
    assert quality.accepted(docs, None).count() == docs.count()
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [1, None, None, 2, 3, 4]))
    assert sum("[EMAIL] and [IP]" in (r["text"] or "") for r in pii.redact(docs).collect()) == 4


def test_empty_stages(spark, docs):
    none = docs.limit(0)
    for stage in (lambda d: quality.accepted(d, None), lambda d: corpus_pipeline.near_dedup(spark, d, ""), pii.redact, lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json"))):
        assert stage(none).count() == 0


def test_texts_of_one_id_are_linked_each(spark):
    """A repeated id drops no text that has no near copy, and a map column does no harm."""
    base = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, base), (1, other), (2, base + " more"), (3, other), (4, "alone " + base[::-1]), (4, "alone " + base[::-1]), (None, base)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), {"k": i or 0}) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row map<string,long>")
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", base), ("1", other), ("4", "alone " + base[::-1]), ("None", base)])


def test_long_texts(spark):
    """A million characters in one row."""
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(160_000))
    df = spark.createDataFrame([(1, text), (2, "short text"), (3, text[:-3])], "doc_id long, text string")
    assert len(text) > 1_000_000
    prints = {r["doc_id"]: r for r in ctph.fingerprints_and_edits(df).collect()}
    assert prints[1]["n_chars"] == len(text) and ctph.likeness(prints[1]["fingerprint"], prints[3]["fingerprint"]) > 0.9
    lengths = {r["doc_id"]: r["length"] for r in packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert lengths[1] > 100_000 and lengths[2] < 10
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(df, labels).count() == 3 and periodic.find_runs(df).where("n_runs = 0").count() == 3 and quality_rules.judge(df, labels).count() == 3
