"""Packing: length buckets of least padding, token-budget batches inside each.

A length is the text's count of tokens, by the given vocabulary's encoder, plus one for the end mark. The global histogram of exact lengths goes
to the driver: n tokens in all have at most sqrt(2 n) distinct lengths (some 7 million at 100 TB). Dynamic
programming over the sorted lengths finds the bucket boundaries whose padding is least; since the best start of a bucket never moves
back as its end moves on, divide and conquer takes each bucket's row in n log n steps, in memory of some 100 bytes a length. A bucket's batches
take ``budget // boundary`` rows each (one, where a single row is longer than the budget); only a bucket's last batch may be short.

Null and empty texts have length 1. Repeated rows are packed as rows; no rows give no batches. Ties between equally good
boundaries go to the smaller one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, extended, numbered, stored, text_batches
from .token_files import _encoder

BUCKETS = 12
BUDGET = 16_384


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper ends of at most ``buckets`` buckets of sorted distinct lengths with the least total padding.

    cost(i, j) pads lengths i..j to lengths[j]; least[k][j] = min over i of least[k-1][i-1] + cost(i, j). No row's starts are kept: each place carries along where the best way
    to it passes the middle bucket, and both halves are then solved alone, so that memory is that of a few rows whatever the number of buckets.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    rows, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    del counts
    ends, open_ = [], [(0, n, min(buckets, n))]
    while open_:
        a, b, k = open_.pop()
        if b <= a:
            continue
        if k == 1:
            ends.append(int(lengths[b - 1]))
            continue
        middle = _middle(lengths[a:b], rows[a : b + 1], tokens[a : b + 1], k, k // 2)
        open_ += [(a, a + middle, k // 2), (a + middle, b, k - k // 2)]
    return sorted(ends)


def _middle(lengths: np.ndarray, rows: np.ndarray, tokens: np.ndarray, buckets: int, half: int) -> int:
    """How many lengths lie in the first ``half`` of at most ``buckets`` buckets."""
    least = lengths * (rows[1:] - rows[0]) - (tokens[1:] - tokens[0])
    through = None
    for k in range(2, buckets + 1):
        base = np.empty(len(lengths), np.int64)
        base[0], base[1:] = tokens[0], least[:-1] + tokens[1:-1]
        del least
        least, source = _next_row(base, lengths, rows, tokens)
        if k == half + 1:
            through = source
        elif k > half + 1:  # starts at 0 had no bucket before
            through = np.where(source > 0, through[np.maximum(source, 1) - 1], 0).astype(np.int32)
    return int(through[-1])


#: Sums that are compared at once.
_AT_ONCE = 1 << 20


def _next_row(base: np.ndarray, lengths: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """min and least argmin over i <= j of base[i] + lengths[j] * (rows[j + 1] - rows[i]) - tokens[j + 1] for each j, level by level:
    the argmins of two places bound those of all places between them."""
    n = len(lengths)
    value, source = np.empty(n, np.int64), np.zeros(n, np.int32)
    low, high = np.array([0], np.int32), np.array([n], np.int32)  # open ranges of places
    first, last = np.array([0], np.int32), np.array([n - 1], np.int32)  # the argmins that they can have
    while len(low):
        mid = (low + high) // 2
        stop = np.minimum(last, mid)
        upto = np.cumsum(stop - first + 1, dtype=np.int64)
        cuts = np.flatnonzero(np.r_[True, np.diff(upto // _AT_ONCE) > 0, True])
        for a, b in zip(cuts, cuts[1:]):
            at = mid[a:b]
            part = (stop[a:b] - first[a:b] + 1).astype(np.int64)
            starts = np.r_[0, np.cumsum(part)[:-1]]
            i = np.arange(part.sum()) - np.repeat(starts - first[a:b], part)
            sums = base[i] - np.repeat(lengths[at], part) * rows[i]
            best = np.minimum.reduceat(sums, starts)
            hits = np.flatnonzero(sums == np.repeat(best, part))
            source[at] = i[hits[np.searchsorted(hits, starts)]]
            value[at] = best + lengths[at] * rows[at + 1] - tokens[at + 1]
        del upto, stop
        found = source[mid]
        left, right = low < mid, mid + 1 < high
        low, high = np.r_[low[left], mid[right] + 1], np.r_[mid[left], high[right]]
        first, last = np.r_[first[left], found[right]], np.r_[found[left], last[right]]
    return value, source


def token_lengths(docs: DataFrame, vocabulary: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, length, columns) of every row of ``docs`` (doc_id, text)."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, F.coalesce("text", F.lit("")).alias("_text"))
    schema = extended(T.StructType([f for f in rows.schema.fields if f.name != "_text"]), length="bigint")

    def run(batches):
        import pyarrow as pa

        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = batch.column("_text")
            lengths = pa.array([encoder.length(t.as_py()) + 1 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lengths], names=[*batch.schema.names[:-1], "length"])

    return rows.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, buckets: int = BUCKETS, budget: int = BUDGET, columns: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, length, bucket, boundary, batch, place, padding) of every row of ``docs`` (doc_id, text).

    ``batch`` is numbered within its bucket, ``place`` within its batch; ``columns`` of the input may follow.
    """
    rows = stored(token_lengths(docs, vocabulary, columns), "packing-lengths")  # texts are read once; the histogram and the batches need only lengths
    ends = [int(x) for x in _ends(rows, buckets)]
    #: At most ``buckets`` boundaries.
    bucket = sum((F.when(F.col("length") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0)).cast("int")
    boundary = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends or [1]]), F.col("bucket") + 1)
    out = numbered(rows.withColumn("bucket", bucket), "bucket", "_at", "packing").withColumn("boundary", boundary)
    discard(rows)
    per = F.greatest(F.floor(F.lit(budget) / F.col("boundary")), F.lit(1)).cast("long")
    out = out.withColumn("batch", F.floor(F.col("_at") / per).cast("long")).withColumn("place", (F.col("_at") % per).cast("int"))
    return out.select("doc_id", "length", "bucket", "boundary", "batch", "place", (F.col("boundary") - F.col("length")).alias("padding"), *columns)


def _ends(rows: DataFrame, buckets: int) -> list[int]:
    seen = rows.groupBy("length").count().orderBy("length").toArrow()
    return boundaries(seen["length"].to_numpy(), seen["count"].to_numpy(), buckets)
