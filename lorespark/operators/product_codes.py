"""Product quantization: a vector as one byte for each subspace, searched by distance tables and scored again on the vectors.

Unit vectors are cut into SUBSPACES pieces, padded with zeros where their length isn't a multiple. Each piece becomes the number of the nearest of CODES centres of its subspace, fitted by
k-means on a bounded sample (FIT rows at most, those of the least hashes of their ids, some 4 MB on the driver for 64 components). Sixteen bytes stand for 64 floats. A query's inner
products with all centres are one table; a row's score is the sum of SUBSPACES entries of it. The best k * oversample of each query are scored again on
their vectors, which are read by id. Rows without a direction (null, zero or non-finite vectors, or of another length) have no codes and are in no search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.batches import bounded
from lorespark.functions import text as T
from lorespark.operators import retrieval
from lorespark.operators.graph_index import _unit
from lorespark.sources import snapshots

SUBSPACES, CODES, FIT, ITERATIONS = 16, 256, 16_384, 12
#: Candidates that are scored again, as a multiple of k.
OVERSAMPLE = 8
#: Queries whose tables are made at once.
AT_ONCE = 128
#: Codes that are scored at once.
ROWS = 4_096


def _pieces(v: np.ndarray, subspaces: int) -> np.ndarray:
    """(rows, subspaces, width) of vectors, padded with zeros."""
    width = -(-v.shape[1] // subspaces)
    return np.pad(v, ((0, 0), (0, width * subspaces - v.shape[1]))).reshape(len(v), subspaces, width)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)


def fit(chunks: DataFrame, subspaces: int = SUBSPACES, codes: int = CODES, sample: int = FIT, seed: int = 7) -> np.ndarray:
    """(subspaces, codes, width): the centres of each subspace, from a sample of chunks (id, vector)."""
    rows = _unit(chunks, "id").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    if not len(rows):
        raise ValueError("there are no vectors to fit on")
    d = len(rows[0])
    v = np.array([x for x in rows.to_pylist() if len(x) == d], np.float32)
    pieces, rng = _pieces(v, subspaces), np.random.default_rng(seed)
    book = np.empty((subspaces, codes, pieces.shape[2]), np.float32)
    for s in range(subspaces):
        x = np.ascontiguousarray(pieces[:, s])
        centres = x[rng.choice(len(x), codes, replace=len(x) < codes)].copy()
        for _ in range(ITERATIONS):
            own = _nearest(x, centres)
            sums, n = np.zeros_like(centres), np.bincount(own, minlength=codes)
            np.add.at(sums, own, x)
            held = n > 0
            centres[held] = sums[held] / n[held, None]
            centres[~held] = x[rng.choice(len(x), int((~held).sum()))]
        book[s] = centres
    return book


def coded(chunks: DataFrame, book: np.ndarray) -> DataFrame:
    """(id, codes) of chunks (id, vector): a byte for each subspace."""
    subspaces, _, width = book.shape
    rows = _unit(chunks, "id").where((F.size("v") <= subspaces * width) & (F.size("v") > subspaces * (width - 1)))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            out = np.zeros((len(sizes), subspaces), np.uint8)
            flat, starts = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)[:-1]]
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                pieces = _pieces(flat[starts[own][:, None] + np.arange(d)], subspaces)
                for s in range(subspaces):
                    out[own, s] = _nearest(pieces[:, s], book[s])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in out], pa.binary())], names=["id", "codes"])

    return rows.transform(bounded).mapInArrow(run, f"id {kind}, codes binary")


def candidates(codes: DataFrame, book: np.ndarray, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, id, near) of the n rows of the largest table sums for each query (query_id, vector); queries go out in blocks of a bounded size."""
    q = snapshots.kept(_unit(queries, "query_id").select("query_id", "v"), "asked")
    #: Read once for each block of queries; coding them goes to Python too, and two stages of it in one task would each hold a worker.
    codes = snapshots.kept(codes, "codes")
    blocks = max(1, -(-q.count() // retrieval.MAX_QUERIES))
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, id {codes.schema['id'].dataType.simpleString()}, near float"
    out = None
    for b in range(blocks):
        own = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        found = _scan(codes, book, own, n, kinds)
        out = found if out is None else out.unionByName(found)
    return retrieval.ranked(out, [F.desc("near"), "id"], n).select("query_id", "id", "near")


def _scan(codes: DataFrame, book: np.ndarray, queries, n: int, kinds: str) -> DataFrame:
    subspaces, _, width = book.shape
    ids, lists = queries.column("query_id").combine_chunks(), queries.column("v").combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    asked, starts = np.zeros((len(sizes), subspaces * width), np.float32), np.r_[0, np.cumsum(sizes)[:-1]]
    for d in np.unique(sizes):
        own, m = np.flatnonzero(sizes == d), min(d, asked.shape[1])
        asked[own, :m] = flat[starts[own][:, None] + np.arange(m)]
    asked = asked.reshape(len(sizes), subspaces, width)

    def run(batches):
        import pyarrow as pa

        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            c = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, subspaces)
            for at in range(0, len(asked), AT_ONCE):
                tables = np.einsum("qsw,scw->qsc", asked[at : at + AT_ONCE], book)
                near = np.zeros((len(tables), len(c)), np.float32)
                for s in range(subspaces):
                    near += tables[:, s, c[:, s]]
                k = min(n, len(c))
                best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.empty((len(tables), 0), np.int64)
                rows = np.repeat(np.arange(len(tables)), k)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows + at)), batch.column("id").take(pa.array(best.ravel())), pa.array(near[rows, best.ravel()])], names=["query_id", "id", "near"])

    return codes.transform(bounded).mapInArrow(run, kinds)


def search(chunks: DataFrame, codes: DataFrame, book: np.ndarray, queries: DataFrame, k: int, oversample: int = OVERSAMPLE) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest chunks (id, vector) by cosine among the best k * oversample by codes."""
    near = candidates(codes, book, queries, k * oversample)
    q = retrieval._few(queries.select("query_id", F.col("vector").cast("array<double>").alias("q")))
    exact = near.join(chunks.select("id", F.col("vector").cast("array<double>").alias("v")), "id").join(q, "query_id")
    scored = exact.select("query_id", "id", T.match_score(1 - T.cosine("v", "q")).alias("score"))
    return retrieval.ranked(scored, [F.desc(F.round("score", 9)), "id"], k)
