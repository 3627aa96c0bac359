"""Approximate nearest neighbours by inner product.

Vectors of norm at most M get one more component, sqrt(M^2 - |x|^2), and queries a zero: the nearest by distance is then the largest
inner product. Gaussian (2-stable) projections give points of PROJECTED dimensions, for which |projected|^2 / |true|^2 follows
a chi-square law. The projection of the added component, which all distances share, is scaled to keep its length.

1. Equal vectors are one row from here on, with the ids that can be among the nearest of any query (at most 2k + 1 distinct ones).
2. A kd-tree over the projected points, fitted on a sample of SAMPLE rows at most, has leaves of about LEAF_ROWS rows. Every row is put
   into its leaf; leaves of more than BLOCK_ROWS rows are dealt into blocks. The leaves' boxes and counts are a small table, at most a
   row for each LEAF_SAMPLE rows of the sample.
3. Queries, one for each distinct vector, go in rounds to the leaves nearest to their projected points: to one leaf, then to FURTHER times as
   many as before. A task has one block of rows and at most about BLOCK_QUERIES queries, sees rows in order of projected distance, and
   stops by the chi-square test: a vector nearer than the k-th found would have been seen already with probability CONFIDENCE. Products of a block
   are formed together, but only those of seen rows count. What was
   found is written after each round, and a query goes on only to leaves that the same test leaves open.

So each query and row is sent once for each leaf and round in which they meet, which is what the data leaves open, not rows times queries.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors whose length differs from the
query's. Nor do rows without a vec_id. Rows that repeat a vec_id are candidates each, but one of them asks, the one of the least
vector; a query's own id is never its candidate. Fewer candidates than k: all of them. Products that overflow are infinite and tie;
those that aren't a number rank as minus infinity. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, discard, stored, text_batches

PROJECTED = 16
CONFIDENCE = 0.87
SAMPLE = 65_536
#: Rows that a leaf is meant to hold, and the least rows of the sample that it's fitted on.
LEAF_ROWS, LEAF_SAMPLE = 4_096, 8
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 4_096
FURTHER = 4


def chi_square_cdf(x: np.ndarray, m: int = PROJECTED) -> np.ndarray:
    """P(chi-square with m degrees <= x), m even."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(m // 2))


def reach(confidence: float = CONFIDENCE, m: int = PROJECTED) -> float:
    """The chi-square value of that probability: beyond so many true squared distances the search stops."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < confidence else (low, mid)
    return high


class Space:
    """The projection of vectors of one size; ``scale`` keeps squares of large components finite, ``norm2`` is M^2 after scaling."""

    def __init__(self, size: int, scale: float, norm2: float):
        self.scale, self.norm2 = scale, norm2
        self.gauss = np.random.default_rng(size).standard_normal((size + 1, PROJECTED))
        self.gauss[size] *= math.sqrt(PROJECTED) / np.linalg.norm(self.gauss[size])

    def rows(self, v: np.ndarray) -> np.ndarray:
        v = v / self.scale
        lift = np.sqrt(np.maximum(self.norm2 - (v**2).sum(axis=1), 0))
        return np.column_stack([v, lift]) @ self.gauss

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q / self.scale) @ self.gauss[:-1]

    def limit(self, q2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The projected squared distance within which the stopping test looks, for queries of squared length q2 (after scaling) and their k-th best score."""
        with np.errstate(over="ignore"):
            true = np.maximum(self.norm2 + q2 - 2 * (score / self.scale / self.scale), 1e-12)
        return np.where(score > -np.inf, REACH * true * (1 + 1e-9), np.inf)


class Tree:
    """A kd-tree as arrays; the widest side is halved at the median. Leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.side, self.at, self.left, self.right, self.leaf = [], [], [], [], []
        leaves, todo = 0, [(np.arange(len(points)), self._node())]
        while todo:
            rows, node = todo.pop()
            p = points[rows]
            spread = p.max(axis=0) - p.min(axis=0) if len(p) else np.zeros(1)
            if len(rows) < 2 * leaf or not spread.max() > 0:
                self.leaf[node] = leaves
                leaves += 1
                continue
            side = int(spread.argmax())
            x = p[:, side]
            cut = np.median(x)
            cut = cut if cut < x.max() else x[x < x.max()].max()
            self.side[node], self.at[node] = side, float(cut)
            self.left[node], self.right[node] = self._node(), self._node()
            todo += [(rows[x <= cut], self.left[node]), (rows[x > cut], self.right[node])]
        self.side, self.at, self.left, self.right, self.leaf = (np.array(x) for x in (self.side, self.at, self.left, self.right, self.leaf))

    def _node(self) -> int:
        for part, x in ((self.side, 0), (self.at, 0.0), (self.left, -1), (self.right, -1), (self.leaf, -1)):
            part.append(x)
        return len(self.leaf) - 1

    def find(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        open_ = np.flatnonzero(self.leaf[node] < 0)
        while len(open_):
            n = node[open_]
            node[open_] = np.where(points[open_, self.side[n]] <= self.at[n], self.left[n], self.right[n])
            open_ = open_[self.leaf[node[open_]] < 0]
        return self.leaf[node]


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (n x d) from boxes (m x d)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d : d + 1]
        out += np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0) ** 2
    return out


#: Distances from leaves that a task holds at once (32 MB).
ROUTED = 1 << 22


def open_places(points: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) of the first-th to last-th box in the order of their distance from each point, as far as squared distances are within the point's limit."""
    rows, boxes, step = [np.empty(0, np.int64)], [np.empty(0, np.int64)], max(1, ROUTED // max(1, len(low)))
    for at in range(0, len(points), step):
        gap, most = gaps(points[at : at + step], low, high), limit[at : at + step]
        if (first, last) == (0, 1):
            box = gap.argmin(axis=1)
            row = np.flatnonzero(gap[np.arange(len(gap)), box] <= most)
            box = box[row]
        else:
            row, box = np.nonzero(gap <= most[:, None])
            order = np.lexsort((box, gap[row, box], row))
            row, box = row[order], box[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, box = row[(place >= first) & (place < last)], box[(place >= first) & (place < last)]
        rows.append(row + at)
        boxes.append(box)
    return np.concatenate(rows), np.concatenate(boxes)


def _no_number_last(s: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(s), -np.inf, s)


#: The nearest rows of a block by projected distance after which the stopping test is made anew.
STEPS = (64, 512, 4096)
#: Pairs of a query and a row that are compared at once (8 MB for each number of a pair).
PAIRS = 1 << 20


def seen(space: Space, score: np.ndarray, p: np.ndarray, q2: np.ndarray, kth: np.ndarray, k: int) -> np.ndarray:
    """Which rows of a block (columns) the stopping test lets each query see, by their projected squared distances ``p``.

    ``kth`` is the k-th best score so far, minus infinity for none. The nearest rows are looked at in STEPS; each k-th best score draws the limit in, until
    no row that wasn't looked at lies within it.
    """
    n, limit = p.shape[1], space.limit(q2, kth)
    fit = p < limit[:, None]
    steps = [m for m in STEPS if k <= m < n]
    if not steps:
        return fit
    order = np.argpartition(p, [m - 1 for m in steps], axis=1)[:, : steps[-1]]
    near = np.where(np.take_along_axis(fit, order, 1), np.take_along_axis(score, order, 1), -np.inf)
    within, open_ = fit, np.arange(len(p))
    for m in steps:
        best = np.maximum(np.partition(near[open_, :m], m - k, axis=1)[:, m - k], kth[open_])
        limit[open_] = np.minimum(limit[open_], space.limit(q2[open_], best))
        now = p[open_] <= limit[open_, None]
        more = now.sum(axis=1) > m
        np.put_along_axis(now, order[open_, :m], True, 1)
        within[open_] &= now
        open_ = open_[more]
        if not len(open_):
            break
    return within


def nearest(space: Space, v: np.ndarray, points: np.ndarray, ids: list, x: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int):
    """(query, vec_id, score, how many rows each query saw) of the k best that each query (row of ``x``) sees in a block: the largest score first, then the
    smaller id, never its ``own``, none that is worse than ``kth``. The block's products are one matrix product; only those of seen rows are used."""
    spot, p2 = space.queries(x), (points**2).sum(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        q2 = ((x / space.scale) ** 2).sum(axis=1)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, begins = np.concatenate(ids).astype(np.int64), np.cumsum(sizes) - sizes
    alone = np.minimum.reduceat(flat, begins) == np.maximum.reduceat(flat, begins)
    out, counts = [], np.zeros(len(x), np.int64)
    step = max(1, PAIRS // len(v))
    for at in range(0, len(x), step):
        q, o, known = x[at : at + step], own[at : at + step], kth[at : at + step]
        p = np.maximum(p2 + (spot[at : at + step] ** 2).sum(axis=1)[:, None] - 2 * spot[at : at + step] @ points.T, 0)
        with np.errstate(over="ignore", invalid="ignore"):
            rough = _no_number_last(q @ v.T)
        for i in np.flatnonzero(o != NO_ID):
            p[i, alone & (flat[begins] == o[i])] = np.inf  # rows that hold nothing but the query's own id
        hit = seen(space, rough, p, q2[at : at + step], known, k) & (p < np.inf)
        counts[at : at + step] = hit.sum(axis=1)
        least = known.copy()
        if len(v) > k:
            least = np.maximum(least, np.partition(np.where(hit, rough, -np.inf), len(v) - k, axis=1)[:, len(v) - k])
        most = np.where(np.isfinite(rough), np.abs(rough), 0).max(axis=1)
        i, row = np.nonzero(hit & (rough >= (least - 1e-9 * most)[:, None]))
        with np.errstate(over="ignore", invalid="ignore"):
            score = _no_number_last((v[row] * q[i]).sum(axis=1))  # the same order of additions for every row, so equal vectors tie
        n = sizes[row]
        each = np.repeat(np.arange(len(row)), n)
        found = flat[np.repeat(begins[row] - (np.cumsum(n) - n), n) + np.arange(len(each))]
        i, score = i[each], score[each]
        keep = (found != o[i]) | (o[i] == NO_ID)
        i, found, score = i[keep], found[keep], score[keep]
        order = np.lexsort((found, -score, i))
        i, found, score = i[order], found[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[keep] + at, found[keep], score[keep]))
    return *(np.concatenate(c) for c in zip(*out)), counts


REACH = reach()


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def search(rows: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score, verified) of the k nearest of each row whose vec_id is divisible by ``every``; ``verified`` counts the
    distinct vectors that the query was compared with."""
    spark = rows.sparkSession
    text_batches(spark)
    kind = rows.schema["embedding"].dataType.simpleString()
    made = []

    def kept(df, name):
        made.append(stored(df, name))
        return made[-1]

    def dropped(df):
        made.remove(df)
        discard(df)

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    fit = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    each = kept(rows.where(fit).groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("c")), "ann-rows")

    #: A query's own id takes at most k places of a vector's list, so the first 2k + 1 places leave k for any query.
    near = each.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_n") <= 2 * k + 1)
    ids = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "c"))), lambda x: F.array_repeat(x["vec_id"], x["c"]))), 1, 2 * k + 1)
    data = kept(near.groupBy("v").agg(ids.alias("ids")).withColumn("size", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "ann-data")

    #: One vector for each asking id. Ids of one vector ask together; an id of several vectors asks for itself, without any of them.
    asks = each.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("several"), F.max("c").alias("c"))
    asks = kept(asks.select("vec_id", "v", F.when((F.col("several") > 1) | (F.col("c") > 1), F.col("vec_id")).otherwise(NO_ID).alias("own")), "ann-asks")
    queries = kept(asks.select("v", "own").distinct().withColumn("size", F.size("v")).withColumn("q", F.monotonically_increasing_id()), "ann-queries")
    members = asks.join(queries.select("v", "own", "q"), ["v", "own"]).select(F.col("vec_id").alias("query_id"), "q")

    scales = data.groupBy("size").agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).cast("double").alias("scale"))
    length2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("scale")) * (x / F.col("scale")))
    facts = {r["size"]: (r["n"], r["scale"], r["norm2"]) for r in data.join(F.broadcast(scales), "size").groupBy("size", "n", "scale").agg(F.max(length2).alias("norm2")).collect()}
    spaces = lambda size: Space(size, *facts[size][1:])

    def project(batches):
        for pdf in batches:
            for size, part in pdf.groupby("size"):
                p = spaces(size).rows(_matrix(part["v"]))
                yield pd.DataFrame({"size": part["size"].to_numpy(), "p": list(p)})

    #: At most SAMPLE rows of PROJECTED numbers come to the driver.
    some = data.select("size", "v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).mapInPandas(project, "size int, p array<double>").toArrow().to_pandas()
    total = sum(n for n, _, _ in facts.values())
    leaf = max(LEAF_SAMPLE, math.ceil(LEAF_ROWS / 2 * min(1.0, SAMPLE / max(1, total))))
    trees = {s: Tree(np.stack(part["p"].to_numpy()), leaf) for s, part in some.groupby("size")} if len(some) else {}
    held = spark.sparkContext.broadcast(trees)

    def place(batches):
        for pdf in batches:
            for size, part in pdf.groupby("size"):
                p = spaces(size).rows(_matrix(part["v"]))
                found = held.value[size].find(p) if size in held.value else np.zeros(len(part), np.int64)
                yield part.assign(p=list(p), leaf=found.astype(np.int32))

    placed = kept(data.mapInPandas(place, f"v {kind}, ids array<long>, size int, row long, p array<double>, leaf int"), "ann-placed")
    sides = [f(F.col("p")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTED)]
    leaves = placed.groupBy("size", "leaf").agg(F.count("*").alias("n"), *sides).orderBy("size", "leaf").toPandas()
    cells = {}
    for size, part in leaves.groupby("size"):
        low, high = (part[[f"{n}{i}" for i in range(PROJECTED)]].to_numpy(float) for n in ("low", "high"))
        cells[size] = (part["leaf"].to_numpy(), -(-part["n"].to_numpy() // BLOCK_ROWS), low, high)
    boxes, most = spark.sparkContext.broadcast(cells), max((len(c[0]) for c in cells.values()), default=0)
    blocks = spark.createDataFrame([(int(s), int(a), int(b)) for s, c in cells.items() for a, b in zip(c[0], c[1])], "size int, leaf int, blocks int")

    def route(first: int, last: int):
        """Queries with the leaves of the first-th to last-th place in the order of their distance, as far as the test leaves them open."""

        def run(batches):
            for pdf in batches:
                for size, part in pdf.groupby("size"):
                    if size not in boxes.value:
                        continue
                    space, (leaf, _, low, high) = spaces(size), boxes.value[size]
                    v = _matrix(part["v"])
                    with np.errstate(over="ignore"):
                        q2 = ((v / space.scale) ** 2).sum(axis=1)
                    limit = space.limit(q2, part["kth"].to_numpy())
                    at, box = open_places(space.queries(v), low, high, limit, first, last)
                    yield part[["q", "own", "v", "kth", "size"]].iloc[at].assign(leaf=leaf[box].astype(np.int32))

        return run

    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0), "verified": np.empty(0, np.int64)})
        space, asked = spaces(int(key[0])), right["q"].to_numpy()
        #: One place more than k, for the own id of a query that asks together with others.
        i, found, score, n = nearest(space, _matrix(left["v"]), _matrix(left["p"]), left["ids"].tolist(), _matrix(right["v"]), right["own"].to_numpy(), right["kth"].to_numpy(), k + 1)
        hits = pd.DataFrame({"q": asked[i], "vec_id": found, "score": score, "verified": 0})
        return pd.concat([hits, pd.DataFrame({"q": asked, "vec_id": NO_ID, "score": 0.0, "verified": n})])

    found, first, last = None, 0, 1
    while first < most:
        state = queries.withColumn("kth", F.lit(-math.inf))
        if found is not None:
            state = queries.join(found.where(F.col("rank") == k + 1).select("q", F.col("score").alias("_s")), "q", "left").withColumn("kth", F.coalesce("_s", F.lit(-math.inf)))
        routed = kept(state.select("q", "own", "v", "kth", "size").mapInPandas(route(first, last), f"q long, own long, v {kind}, kth double, size int, leaf int"), "ann-routed")
        if routed.isEmpty():
            break
        #: A row for each leaf: how many tasks its queries are dealt over.
        wanted = routed.groupBy("size", "leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("askers")).join(F.broadcast(blocks), ["size", "leaf"])
        upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        spread = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
        left = placed.join(F.broadcast(wanted), ["size", "leaf"]).select("size", "leaf", spread("row", F.col("blocks")).alias("block"), upto(F.col("askers")).alias("asker"), "ids", "v", "p")
        right = routed.join(F.broadcast(wanted), ["size", "leaf"]).select("size", "leaf", upto(F.col("blocks")).alias("block"), spread("q", F.col("askers")).alias("asker"), "q", "own", "kth", "v")
        key = ["size", "leaf", "block", "asker"]
        new = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, "q long, vec_id long, score double, verified long")
        new = kept(new, "ann-new")
        every_hit = new if found is None else new.unionByName(found.select("q", "vec_id", "score", "verified"))
        best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        hits = every_hit.where(F.col("vec_id") != NO_ID).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
        counts = every_hit.groupBy("q").agg(F.sum("verified").alias("_v"))
        now = kept(hits.drop("verified").join(counts, "q").select("q", "vec_id", "score", F.when(F.col("rank") == 1, F.col("_v")).otherwise(0).alias("verified"), "rank"), "ann-found")
        for done in (routed, new, *([found] if found is not None else [])):
            dropped(done)
        found, first, last = now, last, last * (FURTHER + 1)

    if found is None:
        found = spark.createDataFrame([], "q long, vec_id long, score double, verified long, rank int")
    out = members.join(found.join(found.groupBy("q").agg(F.sum("verified").alias("_v")), "q").drop("verified", "rank"), "q").where(F.col("vec_id") != F.col("query_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.col("_v").alias("verified"))
    out = stored(out, "ann-neighbours")
    for done in made:
        discard(done)
    return out
