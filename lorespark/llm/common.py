"""What the operators share: tables in the shared folder, gapless numbers, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.sources.snapshots import scratch

#: Bytes of an Arrow batch of texts or files; a batch must fit into a Python worker whatever its rows hold.
BATCH_BYTES = 8 << 20


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, ``spark.checkpoint.dir``."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


#: Stands for a missing id inside Python stages, where integers can't be null.
NO_ID = -(2**63)


def id_column(name: str = "doc_id"):
    """An id as a long that is never null; ``with_nulls`` undoes it."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID)).alias(name)


def with_nulls(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.when(F.col(name) != NO_ID, F.col(name)))


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder, to ``files`` files at most, and read from there: its lineage ends, and a lost
    executor loses nothing of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


#: Bytes that a file of a table between steps holds at least where there are many, and files for each core otherwise.
FILE_BYTES, FILES_A_CORE = 32 << 20, 6


def files_like(df: DataFrame) -> int:
    """Files that a table of the size of ``df``, a frame that ``stored`` gave, or smaller is best written to. However many partitions
    a shuffle has, a step's small tables then don't become as many tasks and files, each of which costs more than its rows."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return max(FILES_A_CORE * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))


def discard(df: DataFrame) -> None:
    """Deletes the files behind a frame that ``stored`` gave, once nothing reads them any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes; every operator sets the same bound, so that none depends on which ran before."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Characters of a text that its range of rows is chosen by, so that an id which many rows share is dealt over several tasks.
HEAD = 64


def in_ranges(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (doc_id, text) in order of doc_id, then text, over n partitions; only rows that repeat both id and HEAD stay in one."""
    return rows.repartitionByRange(n, F.col("doc_id"), F.left("text", F.lit(HEAD))).sortWithinPartitions("doc_id", "text")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def extended(schema: T.StructType, **more: str) -> T.StructType:
    """A schema with further columns of the named types."""
    return T.StructType([*schema.fields, *(T.StructField(n, T.DataType.fromDDL(t)) for n, t in more.items())])


def numbered(df: DataFrame, key: str, out: str, name: str) -> DataFrame:
    """Adds the long column ``out``: 0, 1, 2, ... without gaps within each value of the int column ``key``.

    Order within a key is that of the input's partitions. ``key`` takes a bounded number of values.
    Each task counts its own rows while they stream by; the rows are written with those local numbers,
    and the tasks' totals (tasks x keys rows) give the offsets. No key's rows ever meet in one task.
    """
    schema = extended(df.schema, _task="int", **{out: "bigint"})

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            firsts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.empty(0, np.int64)
            local = np.empty(len(keys), np.int64)
            for i, j in zip(firsts, np.r_[firsts[1:], len(keys)]):
                k = int(keys[order[i]])
                local[order[i:j]] = np.arange(j - i) + seen.get(k, 0)
                seen[k] = seen.get(k, 0) + int(j - i)
            more = [pa.array(np.full(len(keys), task, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_task", out])

    rows = stored(df.mapInArrow(count, schema), name)
    counts = rows.groupBy("_task", key).agg((F.max(out) + 1).alias("_n"))
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = rows.join(offsets, ["_task", key])
    return joined.withColumn(out, F.col(out) + F.col("_before")).select(*df.columns, out)


#: Parts that the links of one node are dealt into where each meets a fact about the node.
SALTS = 16


def _beside(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (a, b) with the column m of ``least`` (a, m); a hot node's edges go to SALTS tasks, each with a copy of its one row."""
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    copies = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["a", "_salt"])


def _distinct_edges(e: DataFrame) -> DataFrame:
    return e.where("a <> b").distinct()


def _starred(edges: DataFrame) -> bool:
    """Whether edges (a > b) are stars: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("n")).agg(F.count_if(F.col("n") > 1)).first()[0] == 0


def components(edges: DataFrame, name: str = "components", files: int | None = None) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is the least node reachable.

    Large star and small star alternate until only stars around least nodes are left; each round is written to the shared
    folder, to ``files`` files at most. Links of one node are joined, not gathered, and dealt over several tasks, so that a hot one doesn't fill a task.
    """
    e = stored(_distinct_edges(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), name, files)
    while not _starred(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _distinct_edges(_beside(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = _beside(down, least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = stored(_distinct_edges(small), name, files)
        discard(e)
        e = new
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
