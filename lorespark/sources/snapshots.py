"""Versioned snapshots: immutable Parquet versions and a pointer that is replaced at once.

``<root>/v=<n>`` holds version n; ``<root>/CURRENT`` names the one that is served and what it was made with. A version is
written, counted and only then pointed to; readers keep what they opened. One version before the served one is kept.

Writers may meet: each claims a version's number by creating a file that mustn't exist, and then the one place after the version that it began from. Only one
writer gets that place; the other's ``publish`` raises ``Conflict``, and ``update`` begins again from what is served by then. Nothing is locked, so a
writer that stopped holds nobody up and can't come back late. ``sources.store`` keeps several tables, writes changes alone and deletes nothing under its readers.
"""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources.store import Conflict, Store, _fs, created, read_file

ATTEMPTS = 20


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and moves it there, so that readers see the old one or the new."""
    fs, target = _fs(spark, path)
    temp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    array = spark.sparkContext._gateway.new_array(options, 1)
    array[0] = options.OVERWRITE
    context.rename(context.makeQualified(temp), context.makeQualified(target), array)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where it's missing or blank."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    text = read_file(spark, path)
    return text if text.strip() else None


def current(spark: SparkSession, root: str) -> dict:
    """The served version's record; empty before the first. Where a writer stopped before it moved the pointer, what comes after the pointer counts."""
    if versions := Store(spark, root).versions():
        return Store(spark, root).record(versions[-1])
    found = json.loads(read_text(spark, f"{root}/CURRENT") or "{}")
    while (after := read_text(spark, f"{root}/after/{found.get('version', 0)}")) is not None:
        found = json.loads(after)
    return found


def read(spark: SparkSession, root: str, record: dict | None = None) -> DataFrame | None:
    """The served version (or that of ``record``), None before the first; a version that is pointed to and missing raises when read."""
    found = current(spark, root) if record is None else record
    if "tables" in found:  # a store of several tables serves its rows
        return Store(spark, root).read("rows", found)
    return spark.read.parquet(f"{root}/v={found['version']}") if found else None


def publish(spark: SparkSession, root: str, rows: DataFrame, expected: int | None = None, before: dict | None = None, **record) -> dict:
    """Writes ``rows`` as the next version, checks its count and serves it, if ``before`` (now: what is served) is still served then."""
    before = current(spark, root) if before is None else before
    version = before.get("version", 0) + 1
    while not created(spark, f"{root}/claims/{version}", ""):
        version += 1
    path = f"{root}/v={version}"
    fs, p = _fs(spark, path)
    rows.write.mode("overwrite").parquet(path)
    count = spark.read.parquet(path).count()
    if expected is not None and count != expected:
        fs.delete(p, True)
        raise ValueError(f"version {version} has {count} rows, {expected} were expected; what was served still is")
    found = {"version": version, "rows": count, "previous": before.get("version"), **record}
    if not created(spark, f"{root}/after/{before.get('version', 0)}", json.dumps(found)):
        fs.delete(p, True)
        raise Conflict(f"{root}: another writer published")
    write_text(spark, f"{root}/CURRENT", json.dumps(found))
    if before.get("previous") is not None:
        fs.delete(_fs(spark, f"{root}/v={before['previous']}")[1], True)
    return found


def update(spark: SparkSession, root: str, change, keep: bool = False, **record) -> dict:
    """Publishes what ``change`` makes of the served rows (None before the first); begins again where another writer was faster.

    ``keep`` carries over what the served version's record says.
    """
    for _ in range(ATTEMPTS):
        before = current(spark, root)
        said = {k: v for k, v in before.items() if k not in ("version", "rows", "previous")} if keep else {}
        try:
            return publish(spark, root, change(read(spark, root, before)), before=before, **(said | record))
        except Conflict:
            continue
    raise Conflict(f"{root}: other writers were faster {ATTEMPTS} times")


def replaced(served: DataFrame, fresh: DataFrame, key: str, changed: DataFrame | None = None) -> DataFrame:
    """Served rows but those of changed keys, and the fresh rows."""
    gone = (fresh if changed is None else changed).select(key).distinct()
    return served.join(gone, key, "left_anti").unionByName(fresh.select(served.columns))


def upsert(spark: SparkSession, root: str, fresh: DataFrame, key: str, changed: DataFrame | None = None, **record) -> dict:
    return update(spark, root, lambda served: fresh if served is None else replaced(served, fresh, key, changed), **record)


def delete(spark: SparkSession, root: str, keys: DataFrame, key: str) -> dict:
    """A version without the rows of the given keys."""
    return update(spark, root, lambda served: served.join(keys.select(key).distinct(), key, "left_anti"), keep=True)


def viability(record: dict | None, wanted: dict) -> tuple[bool, str]:
    """Whether a build may inherit chunks, and why not: what the served version was made with must be known and the same."""
    if not record:
        return False, "nothing is served yet"
    for name in ("index", "chunking", "tokenizer", "parser"):
        if record.get(name) is None:
            return False, f"the served version doesn't record its {name}"
        if record[name] != wanted.get(name):
            return False, f"{name} has changed"
    return True, "unchanged"


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """Rows of a JSON-lines file, or of a folder of them in order of their names, and how many torn lines the end had (0 or 1).

    Blank lines are skipped. Only the last line may be torn, by a writer that stopped; a bad line before it raises. Lines are read in
    parallel; its file's name, where its split starts and its number within that tell the order, so one aggregate finds the last.
    """
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(place.alias("i"), F.col("value").alias("line")).where(F.trim("line") != "")
    rows = lines.withColumn("ok", F.expr("try_parse_json(line)").isNotNull())
    bad = F.when(~F.col("ok"), F.col("i"))
    found = rows.agg(F.max("i").alias("last"), F.min(bad).alias("first_bad"), F.count(bad).alias("n")).first()
    if found["n"] > 1 or (found["n"] and found["first_bad"] != found["last"]):
        raise ValueError(f"{path}: {found['n'] - (1 if found['n'] > 1 else 0) or 1} lines before the last can't be read")
    return rows.where("ok").orderBy("i").select(F.from_json("line", schema).alias("r")).select("r.*"), int(found["n"])


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables between steps, ``spark.checkpoint.dir``; what only one machine sees would lose data on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="lorespark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
