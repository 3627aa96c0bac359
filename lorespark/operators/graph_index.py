"""Navigable graphs over vectors, one for each shard of bounded size, built and searched a shard at a time by numpy while Spark deals shards and queries.

Equal vectors are one node; their rows are members. Nodes are dealt into shards of some SHARD by a hash. A shard's graph has each node's nearest ``degree`` in the shard,
found by matrix products, and as many of the nodes that it is among the nearest of. So a build grows with the rows.

A search meets every shard with every block of queries. It starts at the best of a bounded sample of the shard's nodes (ENTRIES), expands each query's best nodes that were not
expanded yet, scores only nodes it has not seen, and ends when none of the best ``effort`` is left to expand. A shard gives its k best for each query; candidates are never rows
of a table. A search reads a share of each shard, so it grows with rows times queries. Nearness is the cosine; rows without a direction (null, zero or
non-finite vectors, or of another length than the first) are in no search. Results are approximate; tests hold the recall and the share of rows scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions.batches import bounded
from lorespark.operators import blocks
from lorespark.operators.retrieval import ranked
from lorespark.sources import snapshots

DEGREE = 16
#: Nodes of a shard, about; queries that meet it at once; rows or queries of a matrix product.
SHARD, QUERIES, AT_ONCE = 8_192, 4_096, 256
#: Nodes of a shard that a search may start from.
ENTRIES = 256
#: Best nodes that a query keeps, and how many of them it expands in a round.
EFFORT, WIDTH = 64, 16


@dataclass
class Graph:
    edges: DataFrame  # (node, v, neighbours): unit vectors; neighbours are of the same shard
    members: DataFrame  # (node, id, place): rows of equal vectors
    shards: int
    d: int


def _unit(rows: DataFrame, key: str) -> DataFrame:
    v = F.col("vector").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("vector").isNotNull()).where(fine).select(key, v.alias("v")).withColumn("n", T.norm("v"))
    return rows.select(key, F.transform("v", lambda x: F.try_divide(x, F.col("n")).cast("float")).alias("v"))


def _matrix(column, d: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _shard(of: str, shards: int):
    """A node's shard, by the hash that ``blocks.dealt`` deals rows by."""
    return F.pmod(F.xxhash64(of), F.lit(shards)).cast("int")


def _first_of(groups: np.ndarray, n: int) -> np.ndarray:
    """Whether each place of sorted ``groups`` is among the first n of its group."""
    return np.arange(len(groups)) - np.searchsorted(groups, groups) < n


def links(v: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to), sorted: each row's nearest ``degree`` rows of unit vectors, and the nearest as many of the rows that it is among the nearest of."""
    n, k = len(v), min(degree, len(v) - 1)
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    to, score = np.empty((n, k), np.int64), np.empty((n, k), np.float32)
    for at in range(0, n, AT_ONCE):
        s = v[at : at + AT_ONCE] @ v.T
        own = np.arange(len(s))
        s[own, own + at] = -2
        to[at : at + AT_ONCE] = np.argpartition(s, n - k, axis=1)[:, n - k :]
        score[at : at + AT_ONCE] = np.take_along_axis(s, to[at : at + AT_ONCE], axis=1)
    src, dst = np.repeat(np.arange(n), k), to.ravel()
    order = np.lexsort((src, -score.ravel(), dst))
    back = order[_first_of(dst[order], degree)]
    both = np.unique(np.r_[src * n + dst, dst[back] * n + src[back]])
    return both // n, both % n


def build(chunks: DataFrame, degree: int = DEGREE, rounds: int = 0) -> Graph:
    """The graph over chunks (id, vector); ``rounds`` is taken from older callers and does nothing, as neighbours are exact within a shard."""
    import pyarrow as pa

    rows = snapshots.kept(_unit(chunks, "id"), "graph-rows")
    first = rows.select(F.size("v").alias("d")).first()
    d = first["d"] if first else 1
    same = rows.where(F.size("v") == d)
    nodes = snapshots.kept(same.groupBy("v").agg(F.min("id").alias("node")).select("node", "v"), "graph-nodes")
    members = snapshots.kept(ranked(same.join(nodes, "v").select("node", "id"), ["id"], 2**31 - 1, key="node", name="place"), "graph-members")
    shards = max(1, -(-nodes.count() // SHARD))
    kind = nodes.schema["node"].dataType.simpleString()

    def linked(shard):
        ids = shard.column("node").combine_chunks()
        src, dst = links(_matrix(shard.column("v"), d), degree)
        ends = np.searchsorted(src, np.arange(len(ids) + 1))
        return pa.table({"node": ids, "v": shard.column("v"), "neighbours": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids.take(pa.array(dst)))})

    #: A number of partitions that is asked for stays, whatever their size: it's the work that is to be spread.
    dealt = nodes.withColumn("_shard", _shard("node", shards)).repartition(max(shards, 2), "_shard")
    edges = dealt.transform(bounded).groupBy("_shard").applyInArrow(linked, f"node {kind}, v array<float>, neighbours array<{kind}>")
    return Graph(snapshots.kept(edges, "graph"), members, shards, d)


def walked(v: np.ndarray, table: np.ndarray, q: np.ndarray, effort: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(best: len(q) x effort rows of ``v`` found for each query, -1 where there are fewer; how many rows were scored for each).

    ``table`` holds the neighbours of each row, filled up with len(v).
    """
    n, rows = len(v), np.arange(len(q))[:, None]
    entries = np.random.default_rng(7).permutation(n)[:ENTRIES]
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    seen[:, entries] = True
    nodes, scores = np.broadcast_to(entries, (len(q), len(entries))), q @ v[entries].T

    def top(score, k):
        return np.argpartition(score, score.shape[1] - k, axis=1)[:, -k:] if score.shape[1] > k else np.broadcast_to(np.arange(score.shape[1]), score.shape)

    at = top(scores, max(width, 8))
    nodes, scores = np.take_along_axis(nodes, at, axis=1), np.take_along_axis(scores, at, axis=1)
    left = np.ones(nodes.shape, bool)
    while True:
        waiting = np.where(left, scores, -np.inf)
        at = top(waiting, width)
        ok = np.take_along_axis(waiting, at, axis=1) > -np.inf
        some = np.flatnonzero(ok.any(axis=1))
        if not len(some):
            break
        left[rows, at] = False
        open_ = np.where(ok, np.take_along_axis(nodes, at, axis=1), n)[some]
        near = np.sort(table[open_].reshape(len(some), -1), axis=1)
        fresh = ~seen[some[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        i, j = np.nonzero(fresh)
        found = near[i, j]
        seen[some[i], found] = True
        score = np.full(near.shape, -np.inf, np.float32)
        score[i, j] = np.einsum("ij,ij->i", v[found], q[some[i]])
        more_s, more_n = np.full((len(q), near.shape[1]), -np.inf, np.float32), np.full((len(q), near.shape[1]), n, near.dtype)
        more_s[some], more_n[some] = score, near
        scores, nodes, left = np.hstack([scores, more_s]), np.hstack([nodes, more_n]), np.hstack([left, more_s > -np.inf])
        at = top(scores, effort)
        scores, nodes, left = (np.take_along_axis(x, at, axis=1) for x in (scores, nodes, left))
    return np.where(scores > -np.inf, nodes, -1), seen[:, :n].sum(axis=1)


def search(graph: Graph, queries: DataFrame, k: int, effort: int = EFFORT, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score, rank) of the k nearest chunks found for each query (query_id, vector), and (query_id, scored): how many nodes were scored for it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    d, effort = graph.d, max(effort, k)
    q = snapshots.kept(_unit(queries, "query_id").withColumnRenamed("v", "q").where(F.size("q") == d), "graph-queries")
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, node {graph.edges.schema['node'].dataType.simpleString()}, score double, scored long"
    #: Few shards meet more and smaller blocks of queries, so that the work is spread.
    m = max(1, -(-q.count() // QUERIES), -(-2 * q.sparkSession.sparkContext.defaultParallelism // graph.shards))
    left, right, key = blocks.dealt(graph.edges.withColumnRenamed("node", "id"), q, [], graph.shards, m)

    def run(shard, asked):
        shard = shard.sort_by("id")  # equal scores go by id
        ids, query_ids = shard.column("id").combine_chunks(), asked.column("query_id").combine_chunks()
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        if len(ids) and len(query_ids):
            v, qs, near = _matrix(shard.column("v"), d), _matrix(asked.column("q"), d), shard.column("neighbours").combine_chunks()
            sizes = pc.list_value_length(near).to_numpy(zero_copy_only=False)
            table = np.full((len(ids) + 1, max(1, sizes.max())), len(ids), np.int64)
            table[:-1][np.arange(table.shape[1]) < sizes[:, None]] = pc.index_in(near.flatten(), value_set=ids).to_numpy(zero_copy_only=False)
            step = max(8, min(AT_ONCE, AT_ONCE * 64 // d))  # what a round gathers stays bounded for long vectors too
            for at in range(0, len(qs), step):
                some = qs[at : at + step]
                best, scored = walked(v, table, some, effort, width)
                i, j = np.nonzero(best >= 0)
                node = best[i, j]
                score = np.einsum("ij,ij->i", v[node].astype(np.float64), some[i].astype(np.float64))
                order = np.lexsort((node, -np.round(score, 9), i))
                order = order[_first_of(i[order], k)]
                i, node, score = i[order], node[order], score[order]
                out.append((i + at, node, score, np.where(_first_of(i, 1), scored[i], 0)))
        i, node, score, scored = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": query_ids.take(pa.array(i)), "node": ids.take(pa.array(node)), "score": score, "scored": scored.astype(np.int64)})

    found = snapshots.kept(left.transform(bounded).groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, kinds), "graph-found")
    hits = ranked(found, [F.desc(F.round("score", 9)), "node"], k).select("query_id", "node", "score").join(graph.members.where(F.col("place") <= k), "node")
    hits = hits.select("query_id", "id", T.match_score(1 - F.col("score")).alias("score"))
    return ranked(hits, [F.desc(F.round("score", 9)), "id"], k), found.groupBy("query_id").agg(F.sum("scored").alias("scored"))
