"""Hit events as a stream: counts in event-time windows, late rows bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.sources.snapshots import scratch

LATE = "7 days"


def windowed(events: DataFrame, window: str, key: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """(window_start, key, hits) of a stream or table of events (ts, key)."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(span.alias("w"), key).agg(F.count("*").alias("hits")).select(F.col("w.start").alias("window_start"), key, "hits")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of a folder, or one file, as a stream (a stream takes a single file only as a pattern)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_end(spark: SparkSession, path: str, window: str, key: str, slide: str | None = None) -> DataFrame:
    """What a stream over all files now at ``path`` counts: it's stopped when nothing is left to read."""
    name = "hits_" + uuid.uuid4().hex
    out = windowed(stream(spark, path), window, key, slide)
    where = f"{scratch(spark)}/{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{where}/rows/batch={number}")

    spark.createDataFrame([], T.StructType([*out.schema.fields, T.StructField("_batch", T.IntegerType())])).write.parquet(f"{where}/rows/batch=-1")
    #: A window's row is written anew in each batch that changes it; the last one counts.
    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{where}/rows/batch=*")
    names = ("window_start", key)
    return rows.groupBy(*names).agg(F.max_by("hits", "_batch").alias("hits"))
