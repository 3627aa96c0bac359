"""The store as a data source: ``spark.read.format("lorestore").option("table", name).load(root)``.

The served version (or the one of option ``version``) is looked up when a frame is loaded, which stays with it whatever is
committed later. A partition is one file of one bucket. Comparisons of the key with values open the buckets of these values only, and skip the row groups of
files that can't hold them; Spark applies them once more. Deletions meet a file's rows in pieces of ROWS, by their range of keys,
so a task holds no more than those of one range.

Spark doesn't tell Python sources which columns a query needs, so each reads whole rows: ``Store.read`` is the faster way from Python,
this one is for SQL and for readers that know a name and a path. Paths are what pyarrow's file systems know: local disks, HDFS, S3, GCS.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pds
import pyarrow.fs as pfs
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from lorespark.sources.store import BUCKETS

NAME = "lorestore"
#: Rows that are read and compared with deletions at a time.
ROWS = 65_536


def file_system(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        return pfs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pfs.FileSystem.from_uri(path) if "://" in path else (pfs.LocalFileSystem(), path)


def bucket(key: int | str, buckets: int = BUCKETS) -> int:
    """The bucket of a key, as ``store.bucket_of`` deals it (Spark's xxhash64, seed 42)."""
    h = xxhash.xxh64_intdigest(str(key).encode(), 42)
    return (h - 2**64 if h >= 2**63 else h) % buckets


@dataclass
class Part(InputPartition):
    """One file, its segment's number, and the files of later deletions of its bucket."""

    file: str
    seq: int
    gone: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(self.file)


class Reader(DataSourceReader):
    def __init__(self, root: str, name: str, table: dict, buckets: int):
        self.root, self.name, self.table, self.buckets = root, name, table, buckets
        self.names = [f["name"] for f in table["schema"]["fields"]]
        self.keys: list | None = None

    def pushFilters(self, filters: list[Filter]):
        """Takes the values that the key must have; gives all filters back, for Spark to apply."""
        kind = next(f["type"] for f in self.table["schema"]["fields"] if f["name"] == self.table["key"])
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.table["key"],) and kind in ("integer", "long", "string"):
                values = {v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
                self.keys = sorted(values if self.keys is None else values & set(self.keys))
            yield f

    def _files(self, folder: str, segments: list[dict]) -> list[tuple[int, int, str]]:
        """(bucket, number, file) of some segments."""
        fs, at = file_system(f"{self.root}/{folder}")
        wanted = None if self.keys is None else {bucket(k, self.buckets) for k in self.keys}
        found = []
        for s in segments:
            for info in fs.get_file_info(pfs.FileSelector(f"{at}/_segment={s['id']}", allow_not_found=True, recursive=True)):
                where, _, file = info.path.rpartition("/")
                if info.type == pfs.FileType.File and file.endswith(".parquet") and "_bucket=" in where:
                    b = int(where.rpartition("_bucket=")[2])
                    if wanted is None or b in wanted:
                        found.append((b, s["seq"], info.path))
        return sorted(found)

    def partitions(self) -> list[Part]:
        gone: dict[int, list] = {}
        for b, seq, file in self._files(f"{self.name}.gone", self.table["gone"]):
            gone.setdefault(b, []).append((seq, file))
        return [Part(file, seq, [g for g in gone.get(b, []) if g[0] > seq]) for b, seq, file in self._files(self.name, self.table["segments"])]

    def read(self, part: Part):
        fs, _ = file_system(self.root)
        key = self.table["key"]
        schema = to_arrow_schema(T.StructType.fromJson(self.table["schema"]))
        only = None if self.keys is None else pc.field(key).isin(pa.array(self.keys, schema.field(key).type))
        gone = [pds.dataset(g, filesystem=fs, format="parquet") for _, g in part.gone]
        for batch in pds.dataset(part.file, filesystem=fs, format="parquet").to_batches(columns=self.names, filter=only, batch_size=ROWS):
            rows = pa.Table.from_batches([batch])
            if gone and rows.num_rows:
                span = pc.min_max(rows[key])
                low, high = span["min"], span["max"]
                if low.is_valid:
                    for g in gone:
                        taken = g.to_table(columns=[key], filter=(pc.field(key) >= low) & (pc.field(key) <= high))[key]
                        #: A row without a key is never deleted.
                        rows = rows.filter(pc.invert(pc.is_in(rows[key], value_set=taken.combine_chunks(), skip_nulls=True)))
            yield from rows.cast(schema).to_batches()


class StoreSource(DataSource):
    """Options: path (of the store), table, and perhaps version and buckets."""

    @classmethod
    def name(cls) -> str:
        return NAME

    @cached_property
    def _served(self) -> dict:
        """The table's part of the served record; Spark keeps this object, so a frame is bound to it when it is loaded."""
        if "path" not in self.options or "table" not in self.options:
            raise ValueError(f"{NAME} needs a path and the option table")
        fs, at = file_system(self.options["path"].rstrip("/") + "/commits")
        names = [i.base_name for i in fs.get_file_info(pfs.FileSelector(at, allow_not_found=True)) if i.base_name.isdigit()]
        version = self.options.get("version") or max(names, default=None)
        if version is None or f"{int(version):012d}" not in names:
            raise ValueError(f"{self.options['path']} has no version {version}" if version else f"{self.options['path']} has no version yet")
        with fs.open_input_stream(f"{at}/{int(version):012d}") as f:
            tables = json.loads(f.readall())["tables"]
        if self.options["table"] not in tables:
            raise ValueError(f"{self.options['path']} has no table {self.options['table']}")
        return tables[self.options["table"]]

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._served["schema"])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"].rstrip("/"), self.options["table"], self._served, int(self.options.get("buckets", BUCKETS)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets Spark push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoreSource)
