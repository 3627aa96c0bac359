"""Quality classifier: a factorisation machine.

Inputs of a row are its hashed words, structure statistics in logarithmic bins and the text's length (its
metadata). The score is sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): the
sum-of-squares identity makes all pairwise interactions linear in the number of inputs.

The model is fitted with numpy on a bounded sample of labelled rows: those with the least hashes of their ids, at most MAX_TRAIN rows
with MAX_INPUTS inputs in all (two bytes each on the driver). Every document is scored. Labels, lang, source and doc_id are never inputs.

Null and empty texts have only the empty-length input and get that score. Labels that are null are left out; a
document with several labels takes the largest, one with several texts is learnt by the least of them. Rows are scored one by one, so repeated rows repeat their score.
Without any labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import discard, id_column, stored, text_batches, with_nulls

#: Bounds of the training sample: rows, and inputs of all rows together (32 MB).
MAX_TRAIN = 12_000
MAX_INPUTS = 16_000_000
WORD_SLOTS = 1 << 15
BINS = 16
STATS = 17
SLOTS = WORD_SLOTS + STATS * BINS
FACTORS = 8
THRESHOLD = 0.3

_REMEMBERED = 400_000
_UPPER, _TAIL, _DIGIT, _MARK, _LONG = 1, 2, 4, 8, 16


class _Words(dict):
    """word -> slot of the lower-cased word, shifted, and flags of its form."""

    def __missing__(self, word):
        if len(self) >= _REMEMBERED:
            self.clear()
        letters = word.rstrip("!?$%&*#@^~|=+<>_-")
        flags = _UPPER * (len(word) > 1 and word.isupper())
        flags |= _TAIL * (len(word) - len(letters) >= 2) | _DIGIT * any(c.isdigit() for c in word)
        flags |= _MARK * (not any(c.isalnum() for c in word)) | _LONG * (len(word) > 24)
        v = self[word] = (xxh3_64_intdigest(word.lower().encode("utf-8", "replace")) % WORD_SLOTS) << 8 | flags
        return v


_words = _Words()


def _bin(x: float) -> int:
    return min(BINS - 1, int(np.log2(1 + x)))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text: its distinct words at 1/sqrt(count) each, and a slot for each statistic's bin."""
    text = text or ""
    w = text.split()
    v = np.fromiter(map(_words.__getitem__, w), np.int64, len(w))
    slots, n = v >> 8, max(1, len(w))
    words = np.unique(slots)
    share = lambda flag: float(np.count_nonzero(v & flag)) / n
    change = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1], True]) if len(slots) else np.zeros(1, np.int64)
    runs = np.diff(change)
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = [len(x) for x in lines] or [0]
    repeated = len(lines) - len(set(lines))
    stats = [
        _bin(len(text)), _bin(len(w)), _bin(200 * share(_UPPER)), _bin(200 * share(_TAIL)), _bin(200 * share(_DIGIT)),
        _bin(200 * share(_MARK)), _bin(200 * share(_LONG)), _bin(float(runs.max()) if len(runs) else 0), _bin(200 * float(runs[runs > 2].sum()) / n),
        _bin(np.count_nonzero(v & _UPPER)), _bin(np.count_nonzero(v & _TAIL)), _bin(np.count_nonzero(v & _MARK)),
        _bin(repeated), _bin(200 * repeated / max(1, len(lines))), _bin(max(sizes)), min(BINS - 1, int(16 * len(words) / n)), min(BINS - 1, int(2 * len(text) / n)),
    ]
    idx = np.concatenate([words, WORD_SLOTS + BINS * np.arange(STATS) + np.array(stats)]).astype(np.int32)
    val = np.full(len(idx), 0.5, np.float32)
    val[: len(words)] = 1 / np.sqrt(max(1, len(words)))
    return idx, val


def fm_scores(idx: np.ndarray, val: np.ndarray, starts: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Raw scores of rows laid end to end; ``starts`` are the rows' first inputs (each row has at least one)."""
    vx = v[idx] * val[:, None]
    s = np.add.reduceat(vx, starts, axis=0)
    return w0 + np.add.reduceat(w[idx] * val, starts) + 0.5 * (s**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)


def _values(sizes: np.ndarray) -> np.ndarray:
    """Values of the inputs of rows laid end to end, as ``features`` gives them: a row's words first, its STATS bins last."""
    ends = np.cumsum(sizes)
    val = np.repeat((1 / np.sqrt(np.maximum(1, sizes - STATS))).astype(np.float32), sizes)
    val[(ends[:, None] - np.arange(1, STATS + 1)).ravel()] = 0.5
    return val


def fit(slots: np.ndarray, ends: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.08, shrink: float = 1e-5, seed: int = 7):
    """(w0, w, v) by AdaGrad on the logistic loss, from rows' slots laid end to end and where each row ends."""
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(SLOTS, np.float32), rng.normal(0, 0.02, (SLOTS, FACTORS)).astype(np.float32)
    g0, gw, gv = 1e-6, np.full(SLOTS, 1e-6, np.float32), np.full((SLOTS, FACTORS), 1e-6, np.float32)
    firsts = np.r_[0, ends[:-1]]
    for _ in range(epochs):
        order = rng.permutation(len(ends))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            sizes = ends[part] - firsts[part]
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            idx, val = np.concatenate([slots[firsts[i] : ends[i]] for i in part]).astype(np.int32), _values(sizes)
            vx = v[idx] * val[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            raw = w0 + np.add.reduceat(w[idx] * val, starts) + 0.5 * (s**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]).astype(np.float32)
            g0 += float(err.sum()) ** 2
            w0 -= rate * float(err.sum()) / np.sqrt(g0)
            each = np.repeat(err, sizes) * val
            slot, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, each, len(slot)).astype(np.float32) + shrink * w[slot]
            full = each[:, None] * (np.repeat(s, sizes, axis=0) - vx)
            order2 = np.argsort(inv, kind="stable")
            dv = np.add.reduceat(full[order2], np.flatnonzero(np.r_[True, np.diff(inv[order2]) > 0]), axis=0) + shrink * v[slot]
            gw[slot] += dw**2
            gv[slot] += dv**2
            w[slot] -= rate * dw / np.sqrt(gw[slot])
            v[slot] -= rate * dv / np.sqrt(gv[slot])
    return w0, w, v


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_inputs: int = MAX_INPUTS):
    """The model (w0, w, v) from a bounded sample of the labelled rows outside the held-out fifth; None without labels.

    Executors make the inputs; the driver streams them, two bytes each, into one array of at most ``max_inputs``.
    """
    text_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("_label"))
    #: At most max_train rows of 12 bytes, whatever the corpus holds.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches):
        for pdf in batches:
            slots = [features(t)[0].astype("<u2") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["_label"], "n": np.fromiter(map(len, slots), np.int64, len(slots)), "slots": [x.tobytes() for x in slots]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    #: One text for each chosen id, however often the id is repeated, so that what comes to the driver stays bounded.
    rows = rows.groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    rows = stored(rows.mapInPandas(run, "doc_id long, label int, n long, slots binary").withColumn("_hash", F.xxhash64("doc_id")), "quality-inputs")
    kept, room = 0, max_inputs
    sizes = [(r["doc_id"], r["_hash"], r["n"], r["label"]) for r in rows.select("doc_id", "_hash", "n", "label").orderBy("_hash", "doc_id").toLocalIterator()]
    while kept < len(sizes) and sizes[kept][2] <= room:
        room -= sizes[kept][2]
        kept += 1
    if not kept:
        discard(rows)
        return None
    sizes = sorted(sizes[:kept])
    ends = np.cumsum([n for _, _, n, _ in sizes])
    place = {i: at for at, (i, _, _, _) in enumerate(sizes)}
    slots, y = np.empty(int(ends[-1]), np.uint16), np.array([x for _, _, _, x in sizes], np.float32)
    for r in rows.select("doc_id", "slots").toLocalIterator():
        if (at := place.get(r["doc_id"])) is not None:
            own = np.frombuffer(r["slots"], "<u2")
            slots[ends[at] - len(own) : ends[at]] = own
    discard(rows)
    return fit(slots, ends, y)


def _scores(texts: list, model) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    f = [features(t) for t in texts]
    starts = np.r_[0, np.cumsum([len(i) for i, _ in f])[:-1]]
    raw = fm_scores(np.concatenate([i for i, _ in f]), np.concatenate([x for _, x in f]), starts, *model)
    return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def scored(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text). The model (about 1.2 MB, fixed) is broadcast."""
    spark = docs.sparkSession
    text_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": _scores(list(pdf["text"]), held.value)})

    return with_nulls(docs.select(id_column(), "text").mapInPandas(run, "doc_id long, score double"))


def accepted(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least the threshold, with all their columns as they are."""
    spark = docs.sparkSession
    text_batches(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text").to_pylist(), held.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, train(docs, labels, max_train))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
