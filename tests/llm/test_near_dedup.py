import random

import numpy as np

from lorespark.llm import near_dedup as N
from lorespark.llm.common import components
from lorespark.llm import words as W
from lorespark.llm.words import shingles


def words(text):
    return text.encode().lower().split() if text else []


def brute(rows, k, percent):
    """Components over exact links of word tuples; rows that repeat an id are linked by the least of their texts."""
    texts = {}
    for i, t in rows:
        texts[i] = min(x for x in (texts.get(i), t) if x is not None) if texts.get(i) is not None or t is not None else None

    def sets(t):
        w = words(t)
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    s = {i: sets(t) for i, t in texts.items()}
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}, s


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "two words"), (6, "two words more"), (7, "ÄB äb"), (8, "Äb äb")]
    i = 10
    for edits in [0, 0, 0, *range(0, 16), *range(0, 16), 3, 3, 3]:  # one large group of copies, edited a little or much
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
        i += 1
    for n in (3, 4, 5, 8, 12, 30, 500, 3000):
        w = [rng.choice(vocab) for _ in range(n)]
        for cut in (0, 1, max(1, n // 60)):
            rows.append((i, " ".join(w[cut:])))
            i += 1
    line = " ".join(vocab[:40])
    rows += [(i + j, " ".join(rng.choice(vocab) for _ in range(60)) + " " + line) for j in range(40)]
    return rows


def test_against_brute_force(spark):
    rows = corpus() + [(10, corpus()[9][1]), (11, "quite another text under a repeated id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, n int")
    for k in (4, 5):
        want, sets = brute(rows, k, 80)
        got = N.near_duplicates(df, k, 80).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
        once = {i for i, _ in rows if sum(j == i for j, _ in rows) == 1}
        assert all(r["n_shingles"] == len(sets[r["doc_id"]]) for r in got if r["doc_id"] in once)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    chance = N._collisions()
    for n in (5, 60, 200, 5000):
        for j in (0.5, 0.8, 0.95):
            both = max(1, round(2 * n * j / (1 + j)))
            got = []
            for _ in range(12):
                x = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
                a, b = np.unique(x[:n]), np.unique(np.r_[x[:both], x[n : 2 * n - both]])
                true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                ra, rb = np.split(N.registers([a, b]), 2)
                got.append(N.estimate(ra, rb, np.array([len(a)]), np.array([len(b)]), chance)[0] - true)
            assert abs(np.mean(got)) < 0.05


def test_shingles():
    assert len(shingles("a b c d e", 4)) == 2 and len(shingles("a b", 4)) == 1 and len(shingles(None, 4)) == 0
    assert shingles("A\tb\x0bC d", 4).tolist() == shingles("a b c d", 4).tolist() != shingles("a b c\xa0d", 4).tolist()


def test_long_texts_are_cut_at_white_space(monkeypatch):
    text = " ".join(["word" * 200, "Éa", "x\ty", "z" * 700] * 40) + "  end"
    whole = W.word_hashes(text)
    assert len(whole) == len(words(text)) and len(np.unique(whole)) == len(set(words(text)))
    monkeypatch.setattr(W, "PIECE", 50)
    assert W.word_hashes(text).tolist() == whole.tolist() and len(W.word_hashes(" " * 400)) == 0 and len(W.word_hashes("a" * 400)) == 1


def test_registers_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 2, 3, 50, 199, 200, 1000, 5000, 1)]
    many = N.registers(sets)
    assert all((N.registers([h])[0] == r).all() for h, r in zip(sets, many)) and N.registers([]).shape == (0, N.REGISTERS)
    keys = N.band_keys(many)
    assert keys.shape == (9, N.BANDS) and len(np.unique(keys)) == keys.size and (N.band_keys(many[3:4]) == keys[3]).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
