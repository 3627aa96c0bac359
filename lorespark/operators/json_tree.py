"""JSON of any shape as rows: each leaf with its path, some levels at a time in the JVM.

A value becomes a variant once. A pass opens STEP levels of objects and arrays by ``variant_explode`` in one plan and writes what it found: leaves, and the values that are still to be
opened, from which the next pass goes on, so that a deep tree doesn't grow one plan. DEPTH levels are opened; what lies deeper is one row that says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.sources import snapshots

DEPTH = 32
#: Levels that a pass opens.
STEP = 5


def _opened(rows: DataFrame, key: str) -> DataFrame:
    """A level further: members and elements in place of ``v``; rows whose ``v`` has none stay, with ``leaf`` set, and leaves stay as they are."""
    spark = rows.sparkSession
    inner = rows.lateralJoin(spark.tvf.variant_explode_outer(F.when(~F.col("leaf"), F.col("v")).outer()).select("pos", F.col("key").alias("_key"), F.col("value").alias("_value")))
    step = F.when(F.col("_key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("_key")).otherwise(F.concat("path", F.lit("."), "_key"))
    none = F.col("pos").isNull()
    return inner.select(key, F.when(none, F.col("path")).otherwise(step).alias("path"), F.when(none, F.col("v")).otherwise(F.col("_value")).alias("v"), none.alias("leaf"))


def walk(rows: DataFrame, key: str, column: str, depth: int = DEPTH) -> DataFrame:
    """(key, path, kind, value) of every leaf: members as ``a.b``, elements as ``a[0]``.

    ``kind`` is ``scalar``, ``empty_object``, ``empty_array`` or ``too_deep`` (the value is then the JSON text). A null is a scalar without a value; text that isn't JSON
    and null text have no rows.
    """
    level = rows.select(F.col(key), F.lit("").alias("path"), F.try_parse_json(F.col(column)).alias("v"), F.lit(False).alias("leaf")).where(F.col("v").isNotNull())
    out, at = None, 0
    while True:
        last = at + STEP > depth
        for _ in range(min(STEP, depth + 1 - at)):
            level = _opened(level, key)
        at += STEP
        #: Only of leaves is the shape read, which then is a scalar's or an empty one; at the last level also of what would have to be opened.
        shape, done = F.schema_of_variant("v"), F.col("leaf") if not last else F.lit(True)
        empty = F.when(shape == "OBJECT<>", "empty_object").when(F.col("v").cast("string") == "[]", "empty_array")
        kind = F.when(done, F.coalesce(empty, F.when(~F.col("leaf") & (shape.startswith("OBJECT<") | shape.startswith("ARRAY<")), "too_deep"), F.lit("scalar")))
        #: A string's own text; other scalars as JSON writes them.
        value = F.when(F.col("kind").isin("scalar", "too_deep") & (shape != "VOID"), F.coalesce(F.expr("try_variant_get(v, '$', 'string')"), F.to_json("v")))
        found = snapshots.kept(level.withColumn("kind", kind).select(key, "path", "kind", value.alias("value"), F.when(F.col("kind").isNull(), F.col("v")).alias("v")), "json")
        leaf = found.where(F.col("kind").isNotNull()).select(key, "path", "kind", "value")
        out = leaf if out is None else out.unionByName(leaf)
        open_ = found.where(F.col("kind").isNull()).select(key, "path", "v", F.lit(False).alias("leaf"))
        if last or open_.isEmpty():
            return out
        level = open_
