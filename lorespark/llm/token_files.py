"""Token-id files: a wavelet matrix per shard.

A shard's ids are stored as bit planes, the highest bit first; after each plane the sequence is dealt stably into zeros and
ones. Planes are cut into blocks of BLOCK bits, each compressed on its own beside a count of the ones before it, so that
one file answers which id is at a place (access), how often an id occurs before a place (rank, count) and where its j-th
occurrence is (select), reading only the blocks on the way, or gives back all ids at once.

Shards hold ranges of doc_id in ascending order (rows that repeat a doc_id follow one another by text). Spark writes each file
as one row's binary value of a Parquet table: its commit protocol keeps exactly one copy of every file however many
executors are lost, on any file system that Spark writes to.

Null and empty texts are encoded as the end id alone. Documents without an id come first. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import id_column, in_ranges, shuffle_partitions, text_batches, with_nulls

MAGIC = b"WMTOKEN1"
#: The word pattern of byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1 << 16
#: Text bytes that a shard is meant to hold.
SHARD_BYTES = 8 << 20
#: Shards whose places are summed together.
GROUP = 4096
#: White space that tiktoken isn't given in one run: its matcher keeps a place to return to for each character, a million at most.
LONG_RUN = 100_000
_long_run = re.compile(r"(?<!\s)\s{%d}" % LONG_RUN).search


def build(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The file image of ids (unsigned), the documents' ids and the ends of their tokens."""
    width = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    values = ids.astype(np.uint16 if width <= 16 else np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    zeros, parts, sizes, ones_before = [], [], [], []
    for plane in range(width - 1, -1, -1):
        bits = (values >> plane) & 1 != 0
        packed = np.packbits(bits, bitorder="little").tobytes()
        blocks = [packed[i : i + BLOCK // 8] for i in range(0, len(packed), BLOCK // 8)]
        per = np.array([np.count_nonzero(bits[i : i + BLOCK]) for i in range(0, len(bits), BLOCK)], np.int64)
        ones_before.append(np.r_[0, np.cumsum(per)])
        packed = [squeeze(b) for b in blocks]
        parts += packed
        sizes.append(np.array([len(p) for p in packed], np.int64))
        zeros.append(len(bits) - int(per.sum()))
        values = np.concatenate([values.take(np.flatnonzero(~bits)), values.take(np.flatnonzero(bits))])
    head = struct.pack("<8sqqq", MAGIC, len(ids), len(doc_ids), width)
    meta = [np.asarray(zeros, np.int64), *ones_before, *sizes, np.asarray(doc_ids, np.int64), np.asarray(ends, np.int64)]
    index = zstandard.ZstdCompressor(level=3).compress(b"".join(x.astype("<i8").tobytes() for x in meta))
    return head + struct.pack("<q", len(index)) + index + b"".join(parts)


class TokenFile:
    """Reads a file image."""

    def __init__(self, image: bytes):
        magic, self.n, docs, self.width = struct.unpack_from("<8sqqq", image)
        if magic != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<q", image, 32)
        meta = np.frombuffer(zstandard.ZstdDecompressor().decompress(image[40 : 40 + size]), "<i8")
        blocks, w = -(-self.n // BLOCK), self.width
        cut = np.cumsum([w, *[blocks + 1] * w, *[blocks] * w, docs])
        zeros, *rest = np.split(meta, cut)
        self.zeros, self.ones_before = zeros.tolist(), rest[:w]
        offsets = np.r_[0, np.cumsum(np.concatenate(rest[w : 2 * w]) if w else [])].astype(np.int64) + 40 + size
        self._at = lambda plane, b: (int(offsets[plane * blocks + b]), int(offsets[plane * blocks + b + 1]))
        self.doc_ids, self.ends = rest[2 * w], rest[2 * w + 1]
        self.blocks, self._image, self._cache = blocks, memoryview(image), {}

    def _packed(self, plane: int, b: int) -> bytes:
        start, end = self._at(plane, b)
        return zstandard.ZstdDecompressor().decompress(self._image[start:end])

    def _bits(self, plane: int, b: int) -> np.ndarray:
        if (plane, b) not in self._cache:
            if len(self._cache) > 64:
                self._cache.clear()
            bits = np.unpackbits(np.frombuffer(self._packed(plane, b), np.uint8), bitorder="little")
            self._cache[plane, b] = bits[: min(BLOCK, self.n - b * BLOCK)]
        return self._cache[plane, b]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        b, r = divmod(i, BLOCK)
        return int(self.ones_before[plane][b]) + (int(self._bits(plane, b)[:r].sum()) if r else 0)

    def access(self, i: int) -> int:
        value = 0
        for plane in range(self.width):
            bit = int(self._bits(plane, i // BLOCK)[i % BLOCK])
            ones = self._ones(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        if token < 0 or token >> self.width:
            return 0, 0
        for plane in range(self.width):
            a, b = self._ones(plane, low), self._ones(plane, high)
            bit = token >> (self.width - 1 - plane) & 1
            low, high = (self.zeros[plane] + a, self.zeros[plane] + b) if bit else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences among the first i ids."""
        low, high = self._range(token, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) bit of a value in a plane."""
        ones = self.ones_before[plane]
        before = ones if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK, self.n) - ones
        b = int(np.searchsorted(before, j, "right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._bits(plane, b) == bit)[j - int(before[b])])

    def select(self, token: int, j: int) -> int:
        """Place of the j-th occurrence (from 0), or -1."""
        low, high = self._range(token, self.n)
        if not 0 <= j < high - low:
            return -1
        i = low + j
        for plane in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - plane) & 1
            i = self._select_bit(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def all(self) -> np.ndarray:
        """Every id in order: the planes are undone from the lowest up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for plane in range(self.width - 1, -1, -1):
            packed = b"".join(self._packed(plane, b) for b in range(self.blocks))
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[: self.n].view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bits)] = values[: self.zeros[plane]]
            up[np.flatnonzero(bits)] = values[self.zeros[plane] :] | kind(1 << (self.width - 1 - plane))
            values = up
        return values


class TextEncoder:
    """Ids of whole texts by byte-level BPE, equal to those of the tokenizers library.

    Texts are encoded by tiktoken from the same vocabulary (an id is its merge's rank); those that hold a special token or LONG_RUN
    characters of white space in a row go to the tokenizers library, which is loaded when the first one comes.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary, self.special, self.whole = vocabulary, [x["content"] for x in spec["added_tokens"]], None
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.plain = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _whole(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary)
            self.whole.no_truncation()
            self.whole.no_padding()
        return self.whole.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        return self._whole(text) if any(s in text for s in self.special) or (len(text) >= LONG_RUN and _long_run(text)) else self.plain(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.ids(t), np.uint32) for t in texts]

    def length(self, text: str) -> int:
        return len(self.ids(text))


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> TextEncoder:
    """One encoder for each Python worker."""
    return TextEncoder(vocabulary)


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> str:
    """Writes the table (shard, n_docs, n_tokens, file) of all rows of ``docs`` (doc_id, text) to ``path``."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(id_column(), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, total // shard_bytes, min(shuffle_partitions(spark), total // (shard_bytes // 8)))

    def run(batches):
        from pyspark import TaskContext

        encoder, ids, names = _encoder(vocabulary), [], []
        for pdf in batches:
            for i, got in zip(pdf["doc_id"], encoder.encode(list(pdf["text"]))):
                names.append(i)
                ids.append(np.append(got, np.uint32(end_id)))
        if names:
            flat, ends = np.concatenate(ids), np.cumsum([len(x) for x in ids])
            image = build(flat, np.array(names, np.int64), ends)
            yield pd.DataFrame({"shard": np.array([TaskContext.get().partitionId()], np.int32), "n_docs": [len(names)], "n_tokens": [len(flat)], "file": [image]})

    in_ranges(rows, int(shards)).mapInPandas(run, "shard int, n_docs long, n_tokens long, file binary").write.parquet(path)
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files at ``path``."""
    text_batches(spark)
    files = spark.read.parquet(path)
    #: Sums of the shards before each: within groups of GROUP shards, and over the groups, of which there are few.
    counts = files.select("shard", "n_tokens", F.floor(F.col("shard") / GROUP).alias("group"))
    upto = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("group").agg(F.sum("n_tokens").alias("n_tokens")).select("group", upto(Window.orderBy("group")).alias("before"))
    firsts = counts.withColumn("within", upto(Window.partitionBy("group").orderBy("shard"))).join(groups, "group").select("shard", (F.col("within") + F.col("before")).alias("first"))

    def run(batches):
        for pdf in batches:
            for shard, image in zip(pdf["shard"], pdf["file"]):
                f = TokenFile(bytes(image))
                ids, starts = f.all().astype("<u4"), np.r_[0, f.ends[:-1]]
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, f.ends)]
                yield pd.DataFrame({"shard": np.full(len(crc), shard, np.int32), "doc_id": f.doc_ids, "start": starts, "n_tokens": f.ends - starts, "ids_crc32": np.array(crc, np.int64)})

    docs = files.select("shard", "file").mapInPandas(run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return with_nulls(docs.join(firsts, "shard")).select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
