"""The best rows of each query, block by block: Spark deals rows and queries into blocks, numpy scores a pair of blocks at once and lets only the best of each query out.

What is shuffled is rows and queries once for each block that they meet, and k rows a query and block of rows; pairs are never rows of a table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.batches import bounded

#: Queries scored at once against a block of rows.
AT_ONCE = 256


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row of ``scores``, compared to nine digits; of equal ones the first."""
    n = scores.shape[1]
    shown = np.round(scores, 9)
    if n <= k:
        return np.divmod(np.arange(scores.size), max(n, 1))
    least = np.partition(shown, n - k, axis=1)[:, n - k, None]
    keep, equal = shown > least, shown == least
    need = k - keep.sum(axis=1)
    over = np.flatnonzero(equal.sum(axis=1) > need)
    if len(over):
        equal[over] &= np.cumsum(equal[over], axis=1) <= need[over, None]
    return np.nonzero(keep | equal)


def dealt(rows: DataFrame, queries: DataFrame, on: list[str], n: int, m: int, most: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """``rows`` (id) in n blocks and ``queries`` (query_id) in m, each once for every block of the other side, and the key of a pair of blocks.

    ``most``: partitions beyond those of the session; two for each pair of blocks if not given.
    """
    own = lambda column, of: F.pmod(F.xxhash64(column), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    key = [*on, "_row", "_query"]
    left = rows.withColumn("_row", own("id", n)).withColumn("_query", each(m))
    right = queries.withColumn("_query", own("query_id", m)).withColumn("_row", each(n))
    #: A number of partitions that is asked for stays, whatever their size: it's the work that is to be spread.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most or 2 * n * m, 4096))
    return left.repartition(parts, *key), right.repartition(parts, *key), key


def _matrix(column) -> np.ndarray:
    """Arrays of one length as doubles; what is null is not a number."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan"))
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), len(flat) // max(1, len(column)))


def _kinds(rows: DataFrame, queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"


def _found(query_ids, ids, at: list):
    import pyarrow as pa

    i, j, s = (np.concatenate([x[c] for x in at]) if at else np.empty(0, t) for c, t in ((0, np.int64), (1, np.int64), (2, np.float64)))
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return pa.table({"query_id": whole(query_ids).take(pa.array(i)), "id": whole(ids).take(pa.array(j)), "score": pa.array(s)})


def nearest(rows: DataFrame, queries: DataFrame, on: list[str], n: int, m: int, k: int) -> DataFrame:
    """(query_id, id, score): of each pair of blocks the k rows (id, v) of the best match score by cosine for each query (query_id, q); ``on`` has the vectors' length."""
    kinds = _kinds(rows, queries)
    left, right, key = dealt(rows.select("id", "v", *on), queries.select("query_id", "q", *on), on, n, m)

    def run(some, asked):
        some = some.sort_by("id")  # equal scores go by id
        if not len(some) or not len(asked):
            return _found(asked.column("query_id"), some.column("id"), [])
        v, q = _matrix(some.column("v")), _matrix(asked.column("q"))
        out = []
        with np.errstate(all="ignore"):
            vn, qn = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            for at in range(0, len(q), AT_ONCE):
                distance = 1 - q[at : at + AT_ONCE] @ v.T / (qn[at : at + AT_ONCE, None] * vn)
                score = np.where(np.isfinite(distance), np.clip(1 - distance, 0.0, 1.0), 0.0)
                i, j = best_of(score, k)
                out.append((i + at, j, score[i, j]))
        return _found(asked.column("query_id"), some.column("id"), out)

    return left.transform(bounded).groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, kinds)


def best_sums(postings: DataFrame, terms: DataFrame, n: int, m: int, k: int) -> DataFrame:
    """(query_id, id, score): of each pair of blocks the k documents with the largest sum of shares for each query.

    ``postings`` are (term, id, share), ``terms`` (query_id, term, weight); shares and weights are above 0.
    """
    kinds = _kinds(postings, terms)
    #: Some blocks of documents in a partition: the best of each query are cut over all of these before they are shuffled.
    left, right, key = dealt(postings.select("id", "term", "share"), terms.select("query_id", "term", "weight"), [], n, m, -(-n * m // 4))

    def run(some, asked):
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(some) or not len(asked):
            return _found(asked.column("query_id"), some.column("id"), [])
        whole = lambda t, c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
        known = pc.unique(whole(asked, "term"))
        number = pc.index_in(whole(some, "term"), value_set=known)
        some, number = some.filter(pc.is_valid(number)), pc.drop_null(number).to_numpy()
        ids = pc.unique(whole(some, "id"))
        ids = ids.take(pc.sort_indices(ids))  # equal sums go by id
        doc, share = pc.index_in(whole(some, "id"), value_set=ids).to_numpy(zero_copy_only=False), whole(some, "share").to_numpy()
        place = number.astype(np.int64) * max(len(ids), 1) + doc
        order = np.argsort(place, kind="stable")
        place, share = place[order], share[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
        if len(first) < len(place):  # rows that repeat an id count together
            place, share = place[first], np.add.reduceat(share, first)
        number, doc = np.divmod(place, max(len(ids), 1))
        ends = np.searchsorted(number, np.arange(len(known) + 1))
        query_ids = pc.unique(whole(asked, "query_id"))
        query = pc.index_in(whole(asked, "query_id"), value_set=query_ids).to_numpy(zero_copy_only=False)
        term, weight = pc.index_in(whole(asked, "term"), value_set=known).to_numpy(zero_copy_only=False), whole(asked, "weight").to_numpy()
        by_query = np.lexsort((term, query))
        starts = np.searchsorted(query[by_query], np.arange(len(query_ids) + 1))
        out = []
        total = np.zeros(len(ids))
        for i in range(len(query_ids)):
            total[:] = 0.0
            for p in by_query[starts[i] : starts[i + 1]]:
                a, b = ends[term[p]], ends[term[p] + 1]
                total[doc[a:b]] += weight[p] * share[a:b]
            hit = np.flatnonzero(total)
            _, j = best_of(total[None, hit], k)
            out.append((np.full(len(j), i), hit[j], total[hit[j]]))
        return _found(query_ids, ids, out)

    return left.transform(bounded).groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, kinds)
