"""Files as sources and sinks: uploads, folder sizes, small JSON records, append-only logs. Any file system that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.snapshots import _fs, read_text

#: Log rows that a reader is shown.
LOG_TAIL = 500


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, content) of the files below a folder, as ``KnowledgeBase.add`` and ``convert.convert_files`` take them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")


def measure(spark: SparkSession, path: str) -> tuple[int, bool]:
    """Bytes below a folder and whether all of it could be read; a missing folder holds nothing."""
    fs, p = _fs(spark, path)
    try:
        return (int(fs.getContentSummary(p).getLength()), True) if fs.exists(p) else (0, True)
    except Exception:  # noqa: BLE001  a file system says that it can't in ways of its own
        return 0, False


def read_json_or_none(spark: SparkSession, path: str):
    """The value in a small JSON file; None where it's missing or blank."""
    found = read_text(spark, path)
    return None if found is None else json.loads(found)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a JSON-lines folder; files that are there stay as they are."""
    rows.write.mode("append").json(path)


def tail_log(spark: SparkSession, path: str, schema: str, by: str = "at", n: int = LOG_TAIL) -> DataFrame:
    """The last n rows of a JSON-lines folder, the oldest first; lines that can't be read are skipped, a missing log is empty."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.expr("try_parse_json(value)").isNotNull())
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.orderBy(F.desc(by)).limit(n).orderBy(by)
