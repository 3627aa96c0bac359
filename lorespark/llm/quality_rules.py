"""Quality rules: base rules, and an isolation forest on rule statistics.

Every text gives a row of statistics: counts, and the shares that FEATURES names. A tree of the forest parts a subsample of rows by random statistics at
random values until rows stand alone; what is odd stands alone early. The score is 2^(-mean path length / c(subsample)), between 0 and 1, higher for odder rows.

The trees are grown from a bounded sample: of the labelled rows outside the held-out fifth (crc32 of the id), the MAX_SAMPLE ids with the least hashes. Of all labelled
rows outside that fifth, scores are counted by label in BINS classes; the threshold is the one where the share of rejected bad rows less the share of rejected good rows is
largest, among those that reject at most GOOD_LOSS of the good rows. Rows of the base rule don't count for it. All rows are scored.

Null and empty texts have no words; such a text fails the base rule. Repeated rows repeat their result. An id with several labels takes the largest; null labels and ids
are left out of the calibration. Without labels of both kinds there's no threshold, and only the base rule speaks.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_column, stored, text_batches, with_nulls
from .words import word_list, word_numbers

SYMBOLS = "#*$%&|<>"
_HAS_SYMBOL = re.compile(r"[#*$%&|<>]").search
WINDOW = 3
LEAST_WORDS = 50
TREES, SUBSAMPLE, MAX_SAMPLE = 300, 64, 25_600
BINS = 1000
GOOD_LOSS = 0.01
#: Rate at which a rate of symbols counts half: the symbol-to-word ratio that quality rules commonly allow.
HALF = 0.1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbol_kinds", "symbols", "symbol_words", "symbol_lines", "bare_marks", "shouts", "dup_lines", "repeats", "upper"]


def repeat_words(w: np.ndarray) -> int:
    """Words in windows of WINDOW words that stand twice or more in the text, from the words' numbers."""
    n = len(w) - WINDOW + 1
    if n < 2:
        return 0
    key = w[:n]
    for i in range(1, WINDOW):
        key = np.unique(key * len(w) + w[i : i + n], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(key)[key] > 1)
    hit = np.zeros(len(w), bool)
    for i in range(WINDOW):
        hit[twice + i] = True
    return int(hit.sum())


def _half(x: float) -> float:
    return x / (x + HALF)


def statistics(text: str | None) -> tuple:
    """The COUNTS and FEATURES of a text."""
    text = text or ""
    words = word_list(text)
    n = len(words)
    joined = "".join(words)
    size, symbols = len(joined), sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    dup = len(lines) - len(set(lines))
    rep = repeat_words(word_numbers(words))
    with_symbols = sum(1 for x in words if _HAS_SYMBOL(x))
    bare = sum(1 for x in words if not any(map(str.isalnum, x)))
    upper = sum(1 for x in words if len(x) > 1 and x.isupper())
    m, k = max(1, n), max(1, len(lines))
    lines_with = sum(1 for x in lines if _HAS_SYMBOL(x))
    rates = [_half(x) for x in (symbols / m, with_symbols / m, lines_with / k, bare / m, (joined.count("!") + joined.count("?")) / m)]
    return (n, size, symbols, dup, rep, size / m, sum(c in joined for c in SYMBOLS) / len(SYMBOLS), *rates, dup / k, rep / m, upper / m)


def _path(n: int) -> float:
    """Mean length of an unsuccessful search among n rows, c(n)."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(feature, value, length, c) of a forest grown from the rows of ``x``: node i has the children 2i + 1 and 2i + 2, a leaf the feature -1."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    height = max(1, int(np.ceil(np.log2(max(2, size)))))
    feature, value, length = np.full((trees, 2 ** (height + 1) - 1), -1, np.int16), np.zeros((trees, 2 ** (height + 1) - 1)), np.zeros((trees, 2 ** (height + 1) - 1))
    for t in range(trees):
        open_nodes = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
        while open_nodes:
            node, depth, rows = open_nodes.pop()
            low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
            wide = np.flatnonzero(high > low)
            if depth == height or not len(wide):
                length[t, node] = depth + _path(len(rows))
                continue
            f = int(rng.choice(wide))
            v = high[f] - (high[f] - low[f]) * rng.random()  # in (low, high], so that neither side is empty
            feature[t, node], value[t, node] = f, v
            right = rows[:, f] >= v
            open_nodes += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return feature, value, length, max(_path(size), 1e-9)


def oddness(x: np.ndarray, forest) -> np.ndarray:
    """The forest's score of each row, 0 to 1."""
    feature, value, length, c = forest
    out, tree = np.empty(len(x)), np.arange(len(feature))
    for at in range(0, len(x), 1024):
        rows = x[at : at + 1024]
        node = np.zeros((len(rows), len(tree)), np.int64)
        while True:
            f = feature[tree, node]
            if (f < 0).all():
                break
            go = np.take_along_axis(rows, np.maximum(f, 0).astype(np.int64), axis=1) >= value[tree, node]
            node = np.where(f < 0, node, 2 * node + 1 + go)
        out[at : at + 1024] = 2.0 ** (-length[tree, node].mean(axis=1) / c)
    return out


def threshold(histogram: dict[tuple[int, int], int], good_loss: float = GOOD_LOSS) -> float | None:
    """The score from which rows are rejected, from the labelled rows' counts by (label, class); None where a label has no rows."""
    counts = np.zeros((2, BINS + 1), np.int64)
    for (label, b), n in histogram.items():
        counts[label, b] += n
    if not counts.sum(axis=1).all():
        return None
    rejected = counts[:, ::-1].cumsum(axis=1)[:, ::-1] / counts.sum(axis=1, keepdims=True)
    gain = np.where(rejected[1] <= good_loss, rejected[0] - rejected[1], -1.0)
    #: The middle of the classes that do equally well.
    best = np.flatnonzero(gain == gain.max())
    run = best[: int(np.argmax(np.r_[np.diff(best) != 1, True])) + 1]
    return float(run[len(run) // 2]) / BINS


_BASE_FAILED = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words"
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and FEATURES of each row of ``docs`` (doc_id, text)."""
    text_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([statistics(t) for t in pdf["text"]], columns=COUNTS + FEATURES)
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return with_nulls(docs.select(id_column(), "text").mapInPandas(run, _SCHEMA))


def train(stats: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, good_loss: float = GOOD_LOSS):
    """(forest, threshold) from the statistics of labelled rows outside the held-out fifth; None without such rows."""
    outside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("_label")).where(outside)
    rows = stored(stats.where(f"not ({_BASE_FAILED})").select("doc_id", *FEATURES).join(known, "doc_id"), "rule-statistics-known")
    #: One row for each id, so that what comes to the driver is bounded: at most max_sample rows of the features.
    sample = rows.groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("f")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample).select("f.*").collect()
    if not sample:
        discard(rows)
        return None
    forest = grow(np.array([tuple(r) for r in sample], np.float64))
    held = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["_label"], "b": np.floor(oddness(pdf[FEATURES].to_numpy(np.float64), held.value) * BINS).astype(np.int64)})

    counts = rows.mapInPandas(run, "label int, b long").groupBy("label", "b").count().collect()  # two labels by BINS classes
    discard(rows)
    return forest, threshold({(r["label"], r["b"]): r["count"] for r in counts}, good_loss)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, oddness, threshold) of each row of ``docs`` (doc_id, text)."""
    stats = stored(measured(docs), "rule-statistics")
    model = train(stats, labels)
    limit = model[1] if model else None
    if model is None:
        scored = stats.withColumn("oddness", F.lit(None).cast("double"))
    else:
        held = docs.sparkSession.sparkContext.broadcast(model[0])

        def run(batches):
            for pdf in batches:
                yield pdf.assign(oddness=oddness(pdf[FEATURES].to_numpy(np.float64), held.value))

        scored = with_nulls(stats.select(id_column(), *COUNTS, *FEATURES).mapInPandas(run, f"{_SCHEMA}, oddness double"))
    normal = F.lit(True) if limit is None else F.floor(F.col("oddness") * BINS) < F.lit(round(limit * BINS))
    out = scored.withColumn("base_failed", F.expr(_BASE_FAILED))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & normal).alias("kept"), "oddness", F.lit(limit).cast("double").alias("threshold"))
