"""Sharding by longest-processing-time scheduling; the law is ``bytes``.

Rows of equal text are a group and stay together. Groups, largest first, go to the least loaded shard through a heap.
The scheduler sees the distinct sizes of groups and how many have each, exactly: n bytes in all have at most sqrt(2 n) distinct sizes
(some 14 million at 100 TB), two numbers each. Groups of one size are interchangeable, and once loads are level a whole round of them
goes one to each shard. Its answer is kept as runs (how many groups in order of size, which shard). Groups are numbered along a
range partitioning by size, and their numbers tell their shards.

A null text has size 16 and no checksum, and null texts are one group (as are empty ones). Repeated rows are rows of their
group. Fewer groups than shards leave shards empty; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import heapq
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, numbered, shuffle_partitions, stored


def schedule(sizes, counts, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs (end, shard) of groups numbered in order of size, largest first: up to each end they go to its shard, by the heap rule."""
    heap = [(0, s) for s in range(shards)]
    ends, owners, done = array("q"), array("i"), 0
    for size, count in zip(sizes, counts):
        size, count, got = int(size), int(count), {}
        while count:
            if count >= shards and max(heap)[0] - heap[0][0] <= size:
                rounds = count // shards  # loads are within one size: each round gives one to each
                heap = [(x + rounds * size, s) for x, s in heap]
                got = {s: got.get(s, 0) + rounds for _, s in heap}
                count -= rounds * shards
                continue
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            got[s] = got.get(s, 0) + 1
            count -= 1
        for s, n in got.items():
            done += n
            ends.append(done)
            owners.append(s)
    return np.frombuffer(ends, np.int64) if ends else np.empty(0, np.int64), np.frombuffer(owners, np.int32) if owners else np.empty(0, np.int32)


def shard(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    raw = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.md5(raw), F.lit("")).alias("_text"),
    )
    rows = stored(rows, "shard-rows")
    groups = rows.groupBy("_text", "size").agg(F.count("*").alias("n")).select("_text", (F.col("n") * F.col("size")).alias("bytes"))
    groups = stored(groups, "shard-groups")

    seen = groups.groupBy("bytes").agg(F.count("*").alias("n")).orderBy(F.desc("bytes")).toArrow()
    bounds, owner = schedule(seen["bytes"].to_numpy(), seen["n"].to_numpy(), shards)

    #: Numbers of the groups in order of size: written by range, so that each task's first number is known from counts.
    order = groups.repartitionByRange(shuffle_partitions(spark), F.desc("bytes"), F.col("_text")).sortWithinPartitions(F.desc("bytes"), "_text")
    lined = stored(order.select("_text", F.spark_partition_id().alias("_task"), (F.monotonically_increasing_id() % (1 << 33)).alias("_at")), "shard-order")
    sizes = sorted((r["_task"], r["n"]) for r in lined.groupBy("_task").agg(F.count("*").alias("n")).collect())
    first = dict(zip((t for t, _ in sizes), np.r_[0, np.cumsum([n for _, n in sizes])[:-1]].tolist() if sizes else []))
    held = spark.sparkContext.broadcast((bounds, owner, first))

    def place(batches):
        bounds, owner, first = held.value
        for pdf in batches:
            number = pdf["_at"].to_numpy() + pdf["_task"].map(first).to_numpy()
            yield pd.DataFrame({"_text": pdf["_text"], "shard": owner[np.searchsorted(bounds, number, "right")] if len(pdf) else np.empty(0, np.int32)})

    placed = rows.join(lined.select("_text", "_task", "_at").mapInPandas(place, "_text string, shard int"), "_text").drop("_text")
    out = numbered(placed, "shard", "slot", "shard-slots")
    for x in (rows, groups, lined):
        discard(x)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
