"""Tables under one commit log: files by segment and bucket, deletions beside them, one atomic record for all tables.

``<root>/commits/<version>`` is a small JSON record: what the caller says of the version (``meta``) and, for each table, its segments and deletions.
``<root>/<table>/_segment=<id>/_bucket=<b>`` holds rows, dealt by a hash of the table's key; ``<root>/<table>.gone`` holds deleted keys likewise. A change writes
its own rows and keys only: a deletion with number n takes the rows of its keys out of every segment with a smaller number. ``compact`` merges small
segments, ``vacuum`` deletes what no kept version names; neither changes what a version's reader sees.

Writers are optimistic: each reads one version, writes files that nobody sees yet, and then creates the next version's record, which only one writer can. The slower one looks
at what the others changed: other tables or other keys, and its change goes on top of theirs; the same keys, and it raises ``Conflict`` or, with
``drop_changed``, leaves those keys as the others have them. The version's number is the fence: a writer that stopped for hours can't put back an old state. Nothing is locked,
so nothing stays locked. The record is created by a hard link on local disks and by a rename that refuses an existing name elsewhere, which HDFS does atomically; on an object
store without conditional writes two writers could both succeed.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 16
#: Segments of a table from which small ones are merged after a commit.
SEGMENTS = 8
ATTEMPTS = 50
#: Keys of a look-up that are dealt by expressions; more are dealt by a job.
FEW_KEYS = 64


#: Files that a task keeps open where rows come dealt: a writer for each bucket instead of a sort of whole rows.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


class Conflict(RuntimeError):
    """Another writer changed the same rows meanwhile."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_file(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_file(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its whole content; False where one of that name is there already, which then stays."""
    fs, target = _fs(spark, path)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    write_file(spark, temp, text)
    _, t = _fs(spark, temp)
    try:
        if fs.getScheme() == "file":
            os.link(fs.makeQualified(t).toUri().getPath(), fs.makeQualified(target).toUri().getPath())
            return True
        return not fs.exists(target) and bool(fs.rename(t, target))
    except FileExistsError:
        return False
    finally:
        fs.delete(t, False)


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # Versions

    def versions(self) -> list[int]:
        """The versions that have a record, the oldest first."""
        fs, p = _fs(self.spark, f"{self.root}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def record(self, version: int | None = None) -> dict:
        """A version's record, the latest by default; version 0 before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        return json.loads(read_file(self.spark, f"{self.root}/commits/{version:012d}")) if version else {"version": 0, "meta": {}, "tables": {}}

    @property
    def meta(self) -> dict:
        """What the latest version's writers said of it."""
        return self.record()["meta"]

    # Reading

    def _files(self, name: str, parts: list[dict], schema: T.StructType) -> DataFrame:
        """Rows of some segments with the number that each has in the record."""
        at = f"{self.root}/{name}"
        whole = T.StructType([*schema.fields, T.StructField("_segment", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        rows = self.spark.read.schema(whole).option("basePath", at).parquet(*[f"{at}/_segment={p['id']}" for p in parts])
        numbers = F.create_map(*[F.lit(x) for p in parts for x in (p["id"], p["seq"])])
        return rows.withColumn("_seq", F.element_at(numbers, F.col("_segment")).cast("long"))

    def _rows(self, name: str, table: dict, segments: list[dict], only=None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        key, oldest = table["key"], min(s["seq"] for s in segments)
        rows = self._files(name, segments, schema)
        gone = [g for g in table["gone"] if g["seq"] > oldest]
        deleted = self._files(f"{name}.gone", gone, T.StructType([schema[key]])) if gone else None
        if only is not None:
            rows, deleted = rows.where(only), None if deleted is None else deleted.where(only)
        if deleted is not None:
            last = deleted.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_at")).agg(F.max("_seq").alias("_last"))
            rows = rows.join(last, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_at")) & (F.col("_seq") < F.col("_last")), "left_anti")
        return rows

    def read(self, name: str, record: dict | int | None = None, keys: list | None = None) -> DataFrame | None:
        """The rows of a table in a version (its number or record; the latest by default); None where it has none yet. ``keys`` opens their buckets only."""
        found = record if isinstance(record, dict) else self.record(record)
        table = found["tables"].get(name)
        if table is None:
            return None
        schema = T.StructType.fromJson(table["schema"])
        if not table["segments"]:
            return self.spark.createDataFrame([], schema)
        only = None
        if keys is not None:
            kind = schema[table["key"]].dataType
            values = [F.lit(k).cast(kind) for k in keys] if len(keys) <= FEW_KEYS or not all(isinstance(k, (str, int, type(None))) for k in keys) else None
            buckets = [bucket_of(v, self.buckets) for v in values or []]
            if values is None:  # one small job; as expressions each key would take several calls to the JVM
                asked = self.spark.createDataFrame([(str(k),) for k in keys if k is not None], "k string").select(F.col("k").cast(kind).alias("k"))
                dealt = asked.withColumn("b", bucket_of("k", self.buckets)).where("k is not null").collect()
                values, buckets = sorted({r["k"] for r in dealt}), sorted({r["b"] for r in dealt})
            only = F.col("_bucket").isin(*buckets) & F.col(table["key"]).isin(*values) if values else F.lit(False)
        return self._rows(name, table, table["segments"], only).select(*schema.names)

    def changes(self, name: str, since: int, upto: int | None = None) -> DataFrame | None:
        """The distinct keys of a table that versions after ``since`` wrote or deleted; None where none did."""
        found = None
        for v in (x for x in self.versions() if x > since and (upto is None or x <= upto)):
            one = self.record(v)["changed"].get(name)
            if one is None:
                continue
            schema = T.StructType.fromJson(one["schema"])
            for kind, parts in (("", one["segments"]), (".gone", one["gone"])):
                if parts:
                    rows = self._files(name + kind, [p | {"seq": 0} for p in parts], schema if not kind else T.StructType([schema[one["key"]]])).select(one["key"])
                    found = rows if found is None else found.unionByName(rows)
        return None if found is None else found.distinct()

    # Writing

    def begin(self) -> Transaction:
        return Transaction(self)

    def write(self, name: str, rows: DataFrame, key: str, dealt: str | None = None) -> dict:
        """Writes a segment that no version names yet; gives its id, rows and bytes.

        Rows are shuffled into their buckets, unless they come in large partitions of some buckets each: ``dealt`` is then "sorted" where each task orders its
        rows by key, or "ordered" where they have come so (from files of the same key).
        """
        part = f"s{uuid.uuid4().hex}"
        at = f"{self.root}/{name}/_segment={part}"
        placed = rows.withColumn("_bucket", bucket_of(key, self.buckets))
        #: Buckets meet in as few files as their size asks for; one that is large is split. Files are in order of the key, so that a look-up skips most of their pages.
        placed = placed.hint("rebalance", "_bucket") if dealt is None else placed
        placed = placed if dealt == "ordered" else placed.sortWithinPartitions("_bucket", key)
        before = self.spark.conf.get(WRITERS)
        try:
            self.spark.conf.set(WRITERS, str(self.buckets) if dealt == "ordered" else "0")
            placed.write.option("compression", "zstd").partitionBy("_bucket").parquet(at)
        finally:
            self.spark.conf.set(WRITERS, before)
        fs, p = _fs(self.spark, at)
        whole = T.StructType([*rows.schema.fields, T.StructField("_bucket", T.IntegerType())])
        return {"id": part, "rows": self.spark.read.schema(whole).parquet(at).count(), "bytes": int(fs.getContentSummary(p).getLength())}

    def compact(self, name: str, least: int = SEGMENTS) -> bool:
        """Merges the newest segments of a table up to the first that holds more than twice the rows of all newer ones; False where there's nothing to gain."""
        before = self.record()
        table = before["tables"][name]
        parts = sorted(table["segments"], key=lambda s: -s["seq"])
        if len(parts) < least:
            return False
        cut, held = 1, parts[0]["rows"]
        while cut < len(parts) and parts[cut]["rows"] <= 2 * max(1, held):
            held += parts[cut]["rows"]
            cut += 1
        if cut < 2:  # each is far larger than all that follow: merge the newest two, so that their number stays bounded
            cut = 2
        merged, older = parts[:cut], parts[cut:]
        first, last = min(s["seq"] for s in merged), max(s["seq"] for s in merged)
        schema = T.StructType.fromJson(table["schema"])
        rows = self._rows(name, table, merged).select(*schema.names)
        new = self.write(name, rows, table["key"]) | {"seq": last}
        #: Deletions among the merged segments are done; older segments still need them.
        done = [g for g in table["gone"] if first < g["seq"] <= last]
        kept = [self.write(f"{name}.gone", self._files(f"{name}.gone", done, T.StructType([schema[table["key"]]])).select(table["key"]).distinct(), table["key"]) | {"seq": first}] if older and done else []
        gone_ids, merged_ids = {g["id"] for g in done}, {s["id"] for s in merged}
        for _ in range(ATTEMPTS):
            now = self.record()
            t = now["tables"][name]
            if not merged_ids <= {s["id"] for s in t["segments"]}:
                return False
            segments = [s for s in t["segments"] if s["id"] not in merged_ids] + [new]
            oldest = min(s["seq"] for s in segments)
            gone = [g for g in t["gone"] if g["id"] not in gone_ids and g["seq"] > oldest] + kept
            tables = now["tables"] | {name: t | {"segments": segments, "gone": gone}}
            if created(self.spark, f"{self.root}/commits/{now['version'] + 1:012d}", json.dumps(now | {"version": now["version"] + 1, "tables": tables, "changed": {}})):
                return True
        return False

    def vacuum(self, older_than: float = 86_400.0) -> int:
        """Forgets versions but the latest that are older than so many seconds, and deletes files that no version names any more; gives how many folders went."""
        limit = time.time() - older_than
        versions = self.versions()
        fs, _ = _fs(self.spark, self.root)
        path = lambda v: _fs(self.spark, f"{self.root}/commits/{v:012d}")[1]
        for v in versions[:-1]:
            if fs.getFileStatus(path(v)).getModificationTime() / 1000 < limit:
                fs.delete(path(v), False)
        named, names = set(), set()
        for v in self.versions():
            r = self.record(v)
            for name, t in [*r["tables"].items(), *r["changed"].items()]:
                names.add(name)
                named |= {p["id"] for p in t["segments"] + t["gone"]}
        out = 0
        for name in [n + kind for n in names for kind in ("", ".gone")]:
            _, p = _fs(self.spark, f"{self.root}/{name}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName().removeprefix("_segment=") not in named and s.getModificationTime() / 1000 < limit:
                    fs.delete(s.getPath(), True)
                    out += 1
        return out


class Transaction:
    """Changes to several tables that take effect together, or not at all."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.record()
        self._changes: dict[str, dict] = {}
        self._meta: dict = {}

    @property
    def meta(self) -> dict:
        return self.base["meta"] | self._meta

    def read(self, name: str, keys: list | None = None) -> DataFrame | None:
        """The table as it was when the transaction began."""
        return self.store.read(name, self.base, keys)

    def _change(self, name: str, key: str, schema: T.StructType | None) -> dict:
        known = self.base["tables"].get(name, {}).get("schema")
        if schema is None and known is None:
            raise KeyError(f"there is no table {name}")
        if schema is not None:  # files may hold nulls whatever a frame says
            schema = json.loads(T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]).json())
        return self._changes.setdefault(name, {"key": key, "schema": schema or known, "segments": [], "gone": [], "replace": False, "additive": False})

    def append(self, name: str, rows: DataFrame, key: str, additive: bool = False, dealt: str | None = None) -> dict:
        """Adds rows of new keys. Additive rows (sums, marks) stand beside others of their key, so they never conflict. ``dealt`` is as ``Store.write`` takes it."""
        known = self.base["tables"].get(name)
        rows = rows if known is None else rows.select(*T.StructType.fromJson(known["schema"]).names)
        c = self._change(name, key, rows.schema)
        c["additive"] |= additive
        c["segments"].append(part := self.store.write(name, rows, key, dealt))
        return part

    def delete(self, name: str, keys: DataFrame, key: str) -> None:
        """Takes out the rows of some keys."""
        c = self._change(name, key, None)
        kind = T.StructType.fromJson(c["schema"])[key].dataType
        c["gone"].append(self.store.write(f"{name}.gone", keys.select(F.col(key).cast(kind)).where(F.col(key).isNotNull()).distinct(), key))

    def upsert(self, name: str, rows: DataFrame, key: str, changed: DataFrame | None = None, dealt: str | None = None) -> dict:
        """Puts rows in place of those of the same keys, or of the keys of ``changed``, which may have no rows any more."""
        part = self.append(name, rows, key, dealt=dealt)
        if name in self.base["tables"]:
            self.delete(name, (rows if changed is None else changed).select(key), key)
        return part

    def replace(self, name: str, rows: DataFrame, key: str, additive: bool = False, dealt: str | None = None) -> dict:
        """Puts rows in place of the whole table; what others add meanwhile stays, but for additive rows, which belong to what is replaced."""
        c = self._change(name, key, rows.schema)
        c["schema"], c["replace"] = json.loads(T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields]).json()), True
        c["segments"], c["gone"], c["additive"] = [part := self.store.write(name, rows, key, dealt)], [], additive
        return part

    def written(self, name: str) -> DataFrame:
        """The rows that this transaction has written to a table."""
        c = self._changes[name]
        return self.store._files(name, [p | {"seq": 0} for p in c["segments"]], T.StructType.fromJson(c["schema"])).drop("_segment", "_bucket", "_seq")

    def set(self, **meta) -> None:
        self._meta |= meta

    def _keys(self, name: str, c: dict) -> DataFrame:
        schema, found = T.StructType.fromJson(c["schema"]), None
        for kind, parts in (("", c["segments"]), (".gone", c["gone"])):
            if parts:
                rows = self.store._files(name + kind, [p | {"seq": 0} for p in parts], schema if not kind else T.StructType([schema[c["key"]]])).select(c["key"])
                found = rows if found is None else found.unionByName(rows)
        return found.distinct()

    def _settle(self, since: int, upto: int, drop_changed) -> None:
        """Looks for keys that both this and later versions changed; what others changed of them stays."""
        between = [v for v in self.store.versions() if since < v <= upto]
        if len(between) != upto - since:
            raise Conflict("versions since this writer began are forgotten")
        for v in between:
            if names := [n for n, t in self.store.record(v)["changed"].items() if t["replace"] and n in self._changes and not t["additive"]]:
                raise Conflict(f"{', '.join(names)} was replaced by another writer")
        met = {}
        for name, c in self._changes.items():
            theirs = None if c["additive"] else self.store.changes(name, since, upto)
            if theirs is None:
                continue
            both = theirs if c["replace"] else self._keys(name, c).join(theirs, c["key"], "left_semi")
            if not both.isEmpty():
                met[name] = both
        if met and not drop_changed:
            raise Conflict(f"other writers changed the same rows of {', '.join(sorted(met))}")
        for key in {self._changes[n]["key"] for n in met}:
            keys = None
            for n, both in met.items():
                if self._changes[n]["key"] == key:
                    keys = both if keys is None else keys.unionByName(both)
            keys = keys.distinct()
            if callable(drop_changed):
                drop_changed(key, keys)
            for name, c in self._changes.items():
                if c["key"] != key or c["additive"]:
                    continue
                schema = T.StructType.fromJson(c["schema"])
                for kind, own in (("", "segments"), (".gone", "gone")):
                    kept = lambda p: self.store._files(name + kind, [p | {"seq": 0}], schema if not kind else T.StructType([schema[key]])).drop("_segment", "_bucket", "_seq").join(keys, key, "left_anti")  # noqa: B023, E731
                    c[own] = [self.store.write(name + kind, kept(p), key) for p in c[own]]

    def commit(self, drop_changed=False, unless_changed: tuple = (), **meta) -> dict:
        """Makes the changes the next version and gives its record.

        ``drop_changed`` may be a function of a key's name and the keys that others changed, called before these are dropped. Where others changed what the
        record says of one of ``unless_changed``, this raises ``Conflict``.
        """
        self.set(**meta)
        settled = self.base["version"]
        for _ in range(ATTEMPTS):
            now = self.store.record()
            if any(now["meta"].get(k) != self.base["meta"].get(k) for k in unless_changed):
                raise Conflict(f"another writer changed {', '.join(unless_changed)}")
            if now["version"] > settled:
                self._settle(settled, now["version"], drop_changed)
                settled = now["version"]
            seq, tables = now["version"] + 1, dict(now["tables"])
            number = lambda parts: [p | {"seq": seq} for p in parts]  # noqa: B023, E731
            for name, c in self._changes.items():
                t = tables.get(name, {"segments": [], "gone": []})
                segments, gone = t["segments"], t["gone"]
                if c["replace"]:  # what others added since stays
                    if c["additive"]:
                        segments = gone = []
                    known = set() if c["additive"] else {s["id"] for s in self.base["tables"].get(name, {"segments": []})["segments"]}
                    if not known <= {s["id"] for s in segments}:
                        raise Conflict(f"{name} was compacted meanwhile")
                    segments, gone = [s for s in segments if s["id"] not in known], [g for g in gone if g["seq"] > self.base["version"]]
                segments = segments + number(c["segments"])
                oldest = min((s["seq"] for s in segments), default=0)
                tables[name] = {"key": c["key"], "schema": c["schema"], "segments": segments, "gone": [g for g in gone + number(c["gone"]) if g["seq"] > oldest]}
            record = {"version": seq, "meta": now["meta"] | self._meta, "tables": tables, "changed": self._changes, "at": time.time()}
            if created(self.store.spark, f"{self.store.root}/commits/{seq:012d}", json.dumps(record, ensure_ascii=False)):
                for name in self._changes:
                    if len(tables[name]["segments"]) >= SEGMENTS:
                        self.store.compact(name)
                return record
        raise Conflict(f"{self.store.root}: other writers were faster {ATTEMPTS} times")
