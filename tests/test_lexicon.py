"""Words of text without spaces: statistics by brute force, cuts by all cuts, a marked corpus."""

import itertools
import math
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.operators import lexicon, retrieval

WORDS = "数据 分析 文档 检索 系统 知识 图书馆 向量 索引 查询 城市 历史 研究 大学 工程师 语言 模型 计算机 网络 市场 经济 发展 环境 问题 方法 医院 学生 老师 电影院 音乐".split()
LINKS = "的在和是有了不也"
NAME = "翁家翌"


def corpus(n=1500, seed=5):
    """Sentences as lists of words; the single characters of LINKS stand between words."""
    r, out = random.Random(seed), []
    for _ in range(n):
        s = []
        for _ in range(r.randint(3, 8)):
            s.append(r.choice(WORDS))
            if r.random() < 0.5:
                s.append(r.choice(LINKS))
        out.append(s)
    return out


def spans(words):
    ends = list(itertools.accumulate(map(len, words)))
    return set(zip([0, *ends[:-1]], ends))


def texts(spark, data):
    return spark.createDataFrame([(i, t) for i, t in enumerate(data)], "id long, text string")


def test_grams_by_brute_force(spark):
    runs = ["abab", "b", "aab𠀀b", "", "abab"]
    got = {r["gram"]: r for r in lexicon.grams(spark.createDataFrame([(r,) for r in runs] + [(None,)], "run string"), 3).collect()}
    n, before, after = Counter(), {}, {}
    for which, r in enumerate(runs):
        for i in range(len(r)):
            for k in range(1, min(3, len(r) - i) + 1):
                g = r[i : i + k]
                n[g] += 1
                before.setdefault(g, Counter())[r[i - 1] if i else (which, i)] += 1
                after.setdefault(g, Counter())[r[i + k] if i + k < len(r) else (which, i)] += 1
    entropy = lambda c: -sum(x / c.total() * math.log(x / c.total()) for x in c.values())
    assert set(got) == set(n)
    total = sum(v for g, v in n.items() if len(g) == 1)
    for g, row in got.items():
        assert row["n"] == n[g] and abs(row["freedom"] - min(entropy(before[g]), entropy(after[g]))) < 1e-9
        want = [math.log(n[g] * total / (n[g[:i]] * n[g[i:]])) for i in range(1, len(g))]
        assert (row["cohesion"] is None) if not want else abs(row["cohesion"] - min(want)) < 1e-9


@settings(deadline=None, max_examples=80)
@given(st.text("ab中文", min_size=1, max_size=7), st.dictionaries(st.text("ab中文", min_size=1, max_size=3), st.integers(1, 50), max_size=8))
def test_cut_is_likeliest(run, known):
    total = 200
    base = math.log(total)

    def cost(words):
        return sum(base - math.log(known[w]) if w in known else base + lexicon.LETTER * len(w) for w in words)

    every = [[run[a:b] for a, b in zip((0, *at), (*at, len(run)))] for m in range(len(run)) for at in itertools.combinations(range(1, len(run)), m)]
    got = lexicon.cut(run, known, total)
    assert "".join(got) == run and cost(got) <= min(map(cost, every)) + 1e-9


def test_learnt_words_beat_pairs(spark):
    marked = corpus()
    words = lexicon.learnt(texts(spark, ["".join(s) for s in marked]))
    found = {r["word"] for r in words.collect() if len(r["word"]) > 1}
    assert set(WORDS) <= found
    unseen = corpus(200, seed=6)
    rows = {r["id"]: r["tokens"] for r in lexicon.tokens(texts(spark, ["".join(s) for s in unseen]), words).collect()}
    right = given_ = asked = pairs_right = pairs_given = 0
    for i, s in enumerate(unseen):
        want, got, text = spans(s), spans(rows[i]), "".join(s)
        pairs = {(j, j + 2) for j in range(len(text) - 1)}
        right, given_, asked = right + len(want & got), given_ + len(got), asked + len(want)
        pairs_right, pairs_given = pairs_right + len(want & pairs), pairs_given + len(pairs)
    assert right / given_ > 0.9 and right / asked > 0.9
    assert pairs_right / pairs_given < 0.4


def test_a_rare_name_finds_its_only_text(spark):
    """The name's own characters, and pairs of them, stand in many other texts."""
    sentences = ["".join(s) for s in corpus(800)]
    sentences[::40] = [s + "家" for s in sentences[::40]]
    at = len(sentences)
    rows = texts(spark, [*sentences, f"系统的{NAME}和数据", "翁家的图书馆", "城市的家翌和问题"])
    words = lexicon.learnt(rows)
    asked = spark.createDataFrame([(0, NAME), (1, "狼人杀")], "query_id long, text string")
    hits = {(r["query_id"], r["id"]) for r in retrieval.bm25(rows, asked, 100, words).collect()}
    assert hits == {(0, at)}
    assert len({r["id"] for r in retrieval.bm25(rows, asked, 100).collect()}) > 1


def test_mixed_nulls_and_order(spark):
    rows = spark.createDataFrame([(1, "Spark 数据分析 v2，系统"), (1, "Spark 数据分析 v2，系统"), (2, None), (3, ""), (4, "plain Words")], "id long, text string")
    words = spark.createDataFrame([("数据", 5), ("分析", 5), ("系统", 4), ("数", 5), ("据", 5)], "word string, n long")
    got = sorted((r["id"], r["tokens"]) for r in lexicon.tokens(rows, words).collect())
    one = ["spark", "数据", "分析", "v2", "系统"]
    assert got == [(1, one), (1, one), (2, []), (3, []), (4, ["plain", "words"])]
    assert lexicon.learnt(rows.where("id > 1")).count() == 0
