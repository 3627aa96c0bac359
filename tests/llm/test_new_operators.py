"""Clusters, periodic runs and quality rules against brute force, SQL and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespark.llm import clustering, oracles, periodic, quality_rules

DIR = "/root/testdata/sf0.01"
CLASHING = ["x", "n", "part", "cluster", "distance", "words", "b", "_label", "label", "kept", "start", "oddness"]


# Clusters


def brute_clusters(rows, k, rounds, dims):
    keep = [(i, [int(np.floor(1024.0 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in keep if i is not None)
    cs = [x for _, x in start[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in keep]
        cs = [[sum(col) // len(col) for col in zip(*m)] if (m := [x for (_, x), o in zip(keep, own) if o == j]) else c for j, c in enumerate(cs)]
    out = [(i, j, d) for i, x in keep for d, j in [near(x)]]
    inertia = Counter()
    for _, j, d in out:
        inertia[j] += d
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, j, d in out)


def as_rows(df):
    return sorted((str(r[0]), *r[1:]) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("n,dims,k", [(90, 5, 4), (40, 64, 8), (3, 12, 8), (60, 9, 7)])
def test_clusters(spark, n, dims, k):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(n, dims)), 1 if n == 60 else 4))]
    rows += [(n, None), (n + 1, [1.0] * (dims - 1)), (n + 2, [None] + [1.0] * (dims - 1)), (n + 3, [float("nan")] * dims), (n + 4, [float("-inf")] + [0.0] * (dims - 1)), (0, rows[0][1]), (0, rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    assert as_rows(clustering.cluster(df, k=k, rounds=4, dims=dims)) == brute_clusters(rows, k, 4, dims)


def test_clusters_of_ties_and_large_values(spark):
    rows = [(i, [0.0] * 3) for i in range(10)] + [(10, [1e300, 0.0, 0.0]), (11, [-1e300, 5.0, 0.0])]
    got = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, rounds=3, dims=3).collect()
    assert len(got) == 12 and all(0 <= r["distance"] < 2**62 for r in got)
    same = [(i, [0.25] * 3) for i in range(9)]
    assert {r["cluster"] for r in clustering.cluster(spark.createDataFrame(same, "vec_id long, embedding array<double>"), k=4, dims=3).collect()} == {0}
    none = clustering.cluster(spark.createDataFrame(same, "vec_id long, embedding array<double>").limit(0), dims=3)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_partial_distances_abandon_and_stay_exact():
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, (8, 64))
    x = (centres[rng.integers(0, 8, 3000)] + rng.integers(-90, 90, (3000, 64))).astype(np.int64)
    full = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    cluster, distance, work = clustering.nearest(x, centres, np.argsort(-x.var(axis=0)))
    assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all() and work < 0.35 * full.size * 64
    tied = np.zeros((5, 64), np.int64)
    assert (clustering.nearest(tied, np.ones((3, 64), np.int64), np.arange(64))[0] == 0).all()


def test_clusters_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = [(str(r[0]), *r[1:]) for r in con.sql(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({oracles.op11()})").fetchall()]
    assert as_rows(clustering.cluster(spark.read.parquet(f"{DIR}/embeddings.parquet"))) == sorted(want)


# Periodic runs


def brute_runs(w):
    n, found = len(w), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, m, q) for (a, m), q in found.items())


def with_repeats(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 4 else 0):
        a, p, m = rng.randrange(n), rng.randint(1, max(1, n // 4)), rng.randint(1, n)
        u = w[a : a + p]
        w[a : a + m] = (u * (m // len(u) + 1))[:m]
    return w


def test_runs():
    rng = random.Random(3)
    for _ in range(4000):
        w = with_repeats(rng, rng.randint(0, 70), rng.choice([1, 2, 3, 5, 40]))
        assert periodic.runs(np.array(w, np.int64)) == brute_runs(w), w
    for _ in range(30):
        w = with_repeats(rng, rng.randint(200, 700), rng.choice([2, 30, 500]))
        assert periodic.runs(np.array(w, np.int64)) == brute_runs(w)


def test_runs_of_long_texts():
    passage = np.tile(np.random.default_rng(2).integers(0, 2000, 40_000), 5)
    assert periodic.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.runs(passage) == [(0, 200_000, 40_000)]
    assert periodic.runs(np.arange(100_000)) == []


def brute_report(text, doc_id):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (str(doc_id), len(found), *shown, sha("".join(f"{a},{m},{q}\n" for a, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_find_runs(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{x}" for x in with_repeats(rng, rng.randint(0, 120), rng.choice([2, 6, 80]))) for _ in range(250)]
    rows = list(enumerate(texts)) + [(300, None), (301, ""), (302, " \n\t"), (0, texts[0]), (None, "a b " * 9), (None, None), (303, "a b é🎉 " * 12), (-5, "x " * 50), (2**60 + 1, "one two three four " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    got = periodic.find_runs(df, periodic.repeated)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(brute_report(t, i) for i, t in rows)
    assert any(r["n_runs"] > 0 for r in got.collect()) and periodic.find_runs(df.limit(0)).count() == 0


def test_find_runs_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 6000]
    got = periodic.find_runs(docs, periodic.repeated).collect()
    assert len(got) == docs.count()
    by_id = {str(r[0]): (str(r[0]), *r[1:]) for r in got}
    assert all(by_id[str(r["doc_id"])] == brute_report(r["text"], r["doc_id"]) for r in rows)


# Quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def test_counts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b", "é🎉", "#", "|", " ", " ", "\n", "\n", "\t", " ", "x y z "]) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(400, None), (401, ""), (402, "w " * 60), (403, " ".join(map(str, range(200_000)))), (0, texts[0]), (None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    got = quality_rules.judge(df, labels).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in got) == sorted((str(i), *brute_counts(t)) for i, t in rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in got if r["threshold"] is None)
    assert quality_rules.judge(df.limit(0), labels).count() == 0 and quality_rules.judge(df, labels.limit(0)).count() == len(rows)


def brute_length(row, forest, t):
    feature, value, length, _ = forest
    node = 0
    while feature[t, node] >= 0:
        node = 2 * node + (2 if row[feature[t, node]] >= value[t, node] else 1)
    return length[t, node]


def test_forest():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(500, 4)), rng.normal(9, 1, (5, 4))]
    forest = quality_rules.grow(x, trees=40)
    got = quality_rules.oddness(x, forest)
    for i in (0, 17, 501):
        assert got[i] == pytest.approx(2 ** (-np.mean([brute_length(x[i], forest, t) for t in range(40)]) / forest[3]))
    assert got[500:].min() > np.quantile(got[:500], 0.97)
    same = quality_rules.oddness(np.ones((3, 4)), quality_rules.grow(np.ones((3, 4))))
    assert len(set(same)) == 1


def test_threshold():
    assert quality_rules.threshold({(1, 400): 990, (1, 700): 5, (0, 700): 80, (0, 450): 20, (1, 450): 5}) == pytest.approx(0.426, abs=0.03)
    assert quality_rules.threshold({(1, 400): 10}) is None
    assert quality_rules.threshold({(1, 900): 10, (0, 100): 10}) > 0.9


def test_verdicts_on_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_rules.judge(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    got = got[np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]) & ~got["base_failed"].to_numpy(bool)]
    bad, good = got[got["quality"] == 0], got[got["quality"] == 1]
    print(f"rejected {1 - bad['kept'].mean():.3f} of {len(bad)} bad, {1 - good['kept'].mean():.4f} of {len(good)} good")
    assert bad["kept"].mean() < 0.2 and good["kept"].mean() > 0.98
    rank = pd.concat([bad, good])["oddness"].rank().to_numpy()
    assert (rank[: len(bad)].sum() - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(good)) > 0.98
