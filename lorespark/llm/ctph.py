"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes cuts the text wherever it meets a value that the block size sets, so that an edit moves only the
cuts near it. Each piece gives one of 64 letters; a fingerprint is ``block:letters:letters`` for the block size and
its double. The block size follows the whole text's length and is halved while too few pieces result; what follows the
63rd cut is the last piece, so that every byte counts. Two fingerprints are compared at equal block sizes, their likeness
being 1 - d / (l1 + l2) for the edit distance d that counts a replacement as two; without four letters in a row in
common (all of them, where a side has fewer) it's 0.

Null and empty texts have the fingerprint ``4::``; two of them are alike (1), and either is unlike any other text (0). Rows
that repeat a doc_id follow one another by text; those without one come first. A lone row is its own next. Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column, in_ranges, shuffle_partitions, stored, text_batches, with_nulls
from .words import mix

WINDOW = 7
LETTERS = 64
LEAST_BLOCK = 4
GRAM = 4
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BYTE32 = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_BYTE64 = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, remembered and doubled as texts ask for more."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(12, int(n + 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


def fingerprint(data: bytes) -> str:
    n, block = len(data), LEAST_BLOCK
    if not n:
        return f"{LEAST_BLOCK}::"
    x = np.frombuffer(data, np.uint8)
    t = _BYTE32[x]
    rolling = t.copy()
    for k in range(1, min(WINDOW, n)):
        rolling[k:] += t[:-k] * np.uint32(pow(0x01000193, k, 2**32))
    rolling ^= rolling >> np.uint32(15)
    inverse = pow(_BASE, -1, 2**64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE64[x] * _power(_BASE, n)[:n], out=total[1:])

    while block * LETTERS < n:
        block *= 2
    cuts = np.flatnonzero((rolling & np.uint32(block - 1)) == block - 1)
    while len(cuts) < LETTERS // 2 and block > LEAST_BLOCK:
        block //= 2
        cuts = np.flatnonzero((rolling & np.uint32(block - 1)) == block - 1)

    def letters(cuts: np.ndarray) -> str:
        ends = cuts[: LETTERS - 1] + 1
        if not len(ends) or ends[-1] < n:
            ends = np.r_[ends, n]
        starts = np.r_[0, ends[:-1]]
        h = mix((total[ends] - total[starts]) * _power(inverse, n)[starts])
        return _ALPHABET[(h >> np.uint64(58)).astype(np.intp)].tobytes().decode()

    wide = cuts[(rolling[cuts] & np.uint32(2 * block - 1)) == 2 * block - 1]
    return f"{block}:{letters(cuts)}:{letters(wide)}"


def _common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one integer."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    g = min(GRAM, len(a), len(b))
    grams = {a[i : i + g] for i in range(len(a) - g + 1)}
    if not any(b[i : i + g] in grams for i in range(len(b) - g + 1)):
        return 0.0
    return 2 * _common_letters(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """0 to 1 for two fingerprints; 0 where no block size is common."""
    (x, a, aa), (y, b, bb) = one.split(":"), other.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_alike(a, b), _alike(aa, bb)) if a or b else 1.0
    if x == 2 * y:
        return _alike(a, bb)
    return _alike(aa, b) if y == 2 * x else 0.0


def _edited(text: str, after: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def _row(doc_id, text: str, own: str, after: str, next_print: str) -> tuple:
    new = _edited(text, after)
    edited = fingerprint(new.encode("utf-8", "replace")) if new != text else own
    sha = hashlib.sha256(new.encode("utf-8", "replace")).hexdigest()
    return doc_id, len(text), sha, own, edited, likeness(own, edited), likeness(own, next_print)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text) and of its text with the last quarter replaced by the next row's start.

    Rows go once, by ranges of doc_id, to tasks that stream them in order. A task doesn't see what follows its last row: it
    hands on that row's text and its first row's, one of each per task, and these are finished in a second, small step.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(id_column(), F.coalesce("text", F.lit("")).alias("text"))
    rows = in_ranges(rows, shuffle_partitions(spark))

    def run(batches):
        from pyspark import TaskContext

        task, last = TaskContext.get().partitionId(), None
        names = [*_NAMES, "_task", "_head", "_tail"]
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                own = fingerprint(text.encode("utf-8", "replace"))
                if last is None:
                    out.append((i, 0, None, own, None, 0.0, 0.0, task, text, None))
                else:
                    out.append((*_row(*last, text, own), task, None, None))
                last = (i, text, own)
            yield pd.DataFrame(out, columns=names)
        if last is not None:
            yield pd.DataFrame([(last[0], 0, None, last[2], None, 0.0, 0.0, task, None, last[1])], columns=names)

    done = stored(rows.mapInPandas(run, f"{_OUT}, _task int, _head string, _tail string"), "fingerprints")
    tasks = sorted(r["_task"] for r in done.where("_head is not null").select("_task").collect())
    after = dict(zip(tasks, tasks[1:] + tasks[:1]))
    pairs = spark.createDataFrame(list(after.items()) or [(-1, -1)], "_task int, _next int")
    heads = done.where("_head is not null").select(F.col("_task").alias("_next"), "_head", F.col("fingerprint").alias("_print"))
    tails = done.where("_tail is not null").select("doc_id", "fingerprint", "_tail", "_task")

    def finish(batches):
        for pdf in batches:
            got = [_row(i, t, own, h, p) for i, t, own, h, p in zip(pdf["doc_id"], pdf["_tail"], pdf["fingerprint"], pdf["_head"], pdf["_print"])]
            yield pd.DataFrame(got, columns=_NAMES)

    ends = tails.join(pairs, "_task").join(heads, "_next").select("doc_id", "_tail", "fingerprint", "_head", "_print").mapInPandas(finish, _OUT)
    return with_nulls(done.where("_head is null and _tail is null").select(*_NAMES).unionByName(ends))
