"""Embedders: a deterministic bigram-hash embedder in two forms, and batched calls of any embedding function."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lorespark.functions.batches import bounded

DIMENSION = 1024
BATCH = 64
RETRIES = 3

EmbedFn = Callable[[list[str]], list]


def bigram_counts(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """How many places of a text fall into each bucket; a place's bucket hashes its character and the next (the last stands alone)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    bucket = codes % dimension
    bucket[:-1] = (bucket[:-1] * 31 + codes[1:]) % dimension
    return np.bincount(bucket, minlength=dimension)


def bigram_buckets(docs: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(doc_id, buckets, counts): the sparse vector of each text that isn't empty, counted within its row: nothing is shuffled."""
    rows = docs.where("length(text) > 0").select("doc_id", "text")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("buckets array<int>, counts array<long>").fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [bigram_counts(t.as_py(), dimension) for t in batch.column("text")]
            some = [np.flatnonzero(v) for v in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x.astype(np.int32) for x in some], pa.list_(pa.int32())), pa.array([v[x] for v, x in zip(found, some)], pa.list_(pa.int64()))],
                names=schema.names,
            )

    return rows.transform(bounded).mapInArrow(run, schema)


def bigram_vector(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """The same vector, dense and of length one (all zeros for an empty text)."""
    if not text:
        return np.zeros(dimension, np.float32)
    v = bigram_counts(text, dimension).astype(np.float64)
    return (v / np.linalg.norm(v)).astype(np.float32)


def bigram_embedder(texts: list[str]) -> list[np.ndarray]:
    return [bigram_vector(t) for t in texts]


def seated(n: int, answers: list[dict]) -> list:
    """Vectors in the order asked: by each answer's index where all have a valid one, else as they came."""
    if len(answers) != n:
        raise ValueError(f"asked for {n} vectors, got {len(answers)}")
    order = [a.get("index") for a in answers]
    if sorted(i for i in order if isinstance(i, int)) == list(range(n)):
        return [a["embedding"] for a in sorted(answers, key=lambda a: a["index"])]
    return [a["embedding"] for a in answers]


def with_retry(call: Callable, retries: int = RETRIES, base: float = 0.25, most: float = 8.0, sleep=time.sleep, transient=(TimeoutError, ConnectionError)):
    """Calls again after transient errors, waiting twice as long each time; others are raised at once."""
    for attempt in range(retries + 1):
        try:
            return call()
        except transient:
            if attempt == retries:
                raise
            sleep(min(most, base * 2**attempt))


def embedded(chunks: DataFrame, embed: EmbedFn, dimension: int, batch: int = BATCH, count=None) -> DataFrame:
    """Chunks with a ``vector`` column; texts go to ``embed`` in batches within each partition, and a wrong width raises. An accumulator ``count`` is told how many."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType(), False))])

    def run(batches):
        import pyarrow as pa

        for rows in batches:
            vectors = []
            texts = [t or "" for t in rows.column("text").to_pylist()]
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                got = with_retry(lambda part=part: embed(part))
                if len(got) != len(part) or any(len(v) != dimension for v in got):
                    raise ValueError(f"the embedder must give {dimension} components for each text")
                vectors += [np.asarray(v, np.float32) for v in got]
            if count is not None:
                count.add(len(vectors))
            flat = np.concatenate(vectors) if vectors else np.empty(0, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * dimension, pa.int32()), pa.array(flat, pa.float32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, "vector"])

    return chunks.transform(bounded).mapInArrow(run, schema)
