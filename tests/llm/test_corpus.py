"""Personal data, quality, the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from lorespark.llm import pii, quality

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def odd_texts(n=500, seed=1):
    rng = random.Random(seed)
    parts = ["a@b.c", "x.y_z@e-f.gh.i", "@", "a@b", ".", "..", "é", "🎉", " ", "\n", "-", "+", "(", ")", "1", "22", "4418452524842581", "4418 4525-2484 2581", "256", "255.1.2.3", "1.2.3.4.5", "001.002.003.004", "+1 (784) 555-8120", "+12", "word", "_"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_base_spans(spark):
    texts = [*odd_texts(), None, "", "9" * 20_000, "a" * 20_000 + "@b.c", "1." * 5000, "a@" * 5000, "+" + "1 " * 5000]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "k"), (1, "1.2.3.4 under a repeated id", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    want = []
    for i, t, _ in rows:
        s = base_spans(t)
        want.append((i, *(sum(x[0] == k for x in s) for k in pii.KINDS), hashlib.sha256(listed(s).encode()).hexdigest()))
    got = pii.find_pii(df).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)
    for r in got:
        if sum(i == r["doc_id"] for i, _, _ in rows) == 1:
            assert {x for x in listed(base_spans(rows[r["doc_id"]][1])).split(",") if x} <= set(r["spans"].split(","))
    assert pii.find_pii(df.limit(0)).count() == 0


def test_discovery(spark):
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choice("lorem ipsum dolor sit amet the of and".split()) for _ in range(9))
    rows = [f"{filler()} call +1 555 {i:03d} {i * 7:04d} now {filler()}" for i in range(60)]
    rows += [f"{filler()} call 555-{i:03d}-{i * 3:04d} now {filler()}" for i in range(5)]
    rows += [f"{filler()} order 20240{i:04d} shipped {filler()}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    for i in range(60, 65):
        kind, a, b = got[i].split(":")
        assert kind == "phone" and rows[i][int(a) : int(b)] == f"555-{i - 60:03d}-{(i - 60) * 3:04d}"
    assert not any(got[i] for i in range(65, 95))
    text = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert len(text) == len(rows) and all("call [PHONE] now" in text[i] for i in range(65)) and all(text[i] == rows[i] for i in range(65, 95))


def test_discovery_on_the_table(spark):
    """Half of the keys hidden: what stands beside the other half finds them. Recall and precision on ``documents``."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    half = r"^[0-7][0-9a-f]{39}$"
    planted = re.compile(r'(?i)(?<=token = ")[0-9a-f]{40}(?=")')
    hit = wanted = found = 0
    texts = dict(docs.select("doc_id", "text").collect())
    for r in pii.find_spans(docs, half).select("doc_id", F.filter("spans", lambda x: x["kind"] == "secret").alias("s")).collect():
        text = texts[r["doc_id"]] or ""
        hidden = {m.span() for m in planted.finditer(text) if not re.match(half, m[0])}
        got = {(x["start"], x["end"]) for x in r["s"] if not re.match(half, text[x["start"] : x["end"]])}
        hit, wanted, found = hit + len(hidden & got), wanted + len(hidden), found + len(got)
    print(f"recall {hit / wanted:.3f} of {wanted}, precision {hit / max(1, found):.3f}")
    assert wanted > 50 and hit >= 0.9 * wanted and hit >= 0.9 * found


def test_redaction(spark):
    rows = [(1, "a@b.c x 1.2.3.4", 15), (2, "x 4418452524842581 é", 20), (3, None, None), (4, "none", 4), (5, "🎉a@b.c🎉", 7), (5, "🎉a@b.c🎉", 7)]
    got = pii.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "[EMAIL] x [IP]", 14), (2, "x [CARD] é", 10), (3, None, None), (4, "none", 4), (5, "🎉[EMAIL]🎉", 9), (5, "🎉[EMAIL]🎉", 9)]


def test_identity_of_scores():
    rng = np.random.default_rng(1)
    w0, w, v = 0.3, rng.normal(size=quality.SLOTS), rng.normal(size=(quality.SLOTS, quality.FACTORS))
    rows = [quality.features(t) for t in (None, "", "Some words here here, and OTHERS!!\nhere | x", "w " * 3000)]
    starts = np.r_[0, np.cumsum([len(i) for i, _ in rows])[:-1]]
    got = quality.fm_scores(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts, w0, w, v)
    for (idx, val), s in zip(rows, got):
        pairs = sum(float(v[idx[a]] @ v[idx[b]]) * val[a] * val[b] for a in range(len(idx)) for b in range(a))
        assert s == pytest.approx(w0 + float(w[idx] @ val) + pairs, rel=1e-4)


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return d, spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_on_held_out(spark, tables):
    _, docs, labels = tables
    rows = docs.unionByName(spark.createDataFrame([(9_000_001, None, "en", "s", 0), (9_000_002, "", "en", "s", 0), (9_000_002, "", "en", "s", 0)], docs.schema))
    got = quality.score_quality(rows, labels).toPandas()
    assert len(got) == docs.count() + 3 and got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got["doc_id"], got["held_out"]))
    known = got.merge(labels.toPandas(), on="doc_id")
    known = known[known["held_out"]]
    rank, y = known["score"].rank().to_numpy(), known["quality"].to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.9
    assert set(quality.score_quality(rows, labels.limit(0)).toPandas()["score"]) == {0.5}


def test_training_sample_is_bounded_by_inputs(spark, tables):
    """Rows go into the sample in order of their ids' hashes until the next one would pass the bound."""
    from pyspark.sql import functions as F

    _, docs, labels = tables
    known = labels.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("quality").isNotNull())
    order = [r["doc_id"] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    text = dict(docs.select("doc_id", "text").collect())
    sizes = np.cumsum([len(quality.features(text[i])[0]) for i in order])
    few = labels.where(F.col("doc_id").isin(order[:40]))
    for one, other in zip(quality.train(docs, labels, max_inputs=int(sizes[39])), quality.train(docs, few)):
        assert np.array_equal(one, other)
    assert quality.train(docs, labels, max_inputs=1) is None


def test_values_of_inputs():
    rows = [quality.features(t) for t in (None, "a b a", "w " * 50)]
    assert np.array_equal(quality._values(np.array([len(i) for i, _ in rows])), np.concatenate([x for _, x in rows]))


def test_labels_of_other_rows_are_never_read(spark, tables):
    """Scores don't change when the held-out labels do."""
    from pyspark.sql import functions as F

    _, docs, labels = tables
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    few = docs.where("doc_id < 40")
    scores = lambda x: [r["score"] for r in quality.scored(few, quality.train(docs, x)).orderBy("doc_id").collect()]
    assert scores(labels) == scores(flipped)


def test_pipeline_stage_by_stage(spark, tables):
    from test_near_dedup import brute

    d, docs, labels = tables
    kept = corpus_pipeline.quality(spark, docs, d)
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_quality(docs, labels).collect()}
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert kept.columns == docs.columns and ids == {i for i, p in scores.items() if p}
    once = corpus_pipeline.near_dedup(spark, kept, d)
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want, _ = brute(texts, 5, 80)
    assert once.columns == docs.columns and sorted(r["doc_id"] for r in once.collect()) == sorted(set(want.values()))
    clean = corpus_pipeline.pii(spark, once, d)
    before, after = dict(r for r in once.select("doc_id", "text").collect()), dict(r for r in clean.select("doc_id", "text").collect())
    assert clean.columns == docs.columns and before.keys() == after.keys()
    for i, t in before.items():
        assert not any(t[a:b] in after[i] and k != "ip" for k, a, b in base_spans(t)) and (base_spans(t) or after[i] == t or "[SECRET]" in after[i])
    packed = corpus_pipeline.packing(spark, clean, d).collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(after)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "packing"]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()) == sorted(after)
