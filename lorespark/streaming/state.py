"""State that a stream keeps by key: what each document last held, and hits that expire.

State is in RocksDB with its checkpoint, so it may outgrow memory and a lost executor loses none of it; a restart from the checkpoint goes on where the stream
stopped. A document's state is 40 bytes, held with those of its group, since a call of Python and a look-up for each document would cost more than its text; hits are counted by
key and hour, so that a key of a third of all hits has as many groups as hours.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from lorespark.functions.batches import bounded

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hits of an hour are counted together and expire together.
SLOT_MS = 3_600_000
DAY_MS = 24 * SLOT_MS
#: Groups that documents' digests are held in: some 370 of three million documents. A checkpoint keeps the number that it was made with.
GROUPS = 8_192
#: Bytes of a digest.
DIGEST = 32


@contextmanager
def rocks(spark: SparkSession):
    """Streams that are started within keep their state in RocksDB, as these operators need; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Changed(StatefulProcessor):
    """Lets the last rows of a group's documents pass where their content isn't what passed before; the group's digests are one value, read and written once a micro-batch."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("digests", "ids binary, digests binary")

    def handleInputRows(self, key, rows, timerValues):
        held = self.last.get()
        ids, digests = (np.frombuffer(held[0], np.int64), np.frombuffer(held[1], f"V{DIGEST}")) if held else (np.empty(0, np.int64), np.empty(0, f"V{DIGEST}"))
        known = dict(zip(ids.tolist(), digests.tolist()))
        #: Of each document the last row; its text is held only where it may pass.
        latest = {}
        for pdf in rows:
            for doc, text, at, digest in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["at"].tolist(), pdf["digest"]):
                digest = bytes(digest)
                if doc not in latest or (at, digest) > latest[doc][:2]:
                    latest[doc] = (at, digest, None if known.get(doc) == digest else text)
        fresh = {doc: row for doc, row in latest.items() if known.get(doc) != row[1]}
        if fresh:
            known |= {doc: row[1] for doc, row in fresh.items()}
            self.last.update((np.fromiter(known, np.int64, len(known)).tobytes(), b"".join(known.values())))
            yield pd.DataFrame({"doc_id": np.fromiter(fresh, np.int64, len(fresh)), "text": pd.Series([row[2] for row in fresh.values()], dtype=object)})

    def close(self) -> None:
        pass


def changed_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text) of a stream of documents (doc_id, text, perhaps at) whose text differs from what the stream last gave of that doc_id.

    Of several rows of a document in a micro-batch the last by ``at`` (without one: by the digest of the text) counts. A null text is a content of its
    own. Rows without a doc_id are left out, since nothing says what they replace. Start the stream within ``rocks``.
    """
    at = F.coalesce(F.col("at").cast("double"), F.lit(0.0)) if "at" in documents.columns else F.lit(0.0)
    #: No text has a digest of zeros.
    digest = F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(bytes(DIGEST)))
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", at.alias("at"), digest.alias("digest"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).cast("int"))
    return rows.transform(bounded).groupBy("group").transformWithStateInPandas(_Changed(), "doc_id long, text string", "Append", "None")


class _Live(StatefulProcessor):
    """Counts the hits of a key and hour until they are too old."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle, self.count = handle, handle.getValueState("hits", "hits long")

    def _row(self, key, hits: int) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "slot": [key[1]], "hits": [hits]})

    def handleInputRows(self, key, rows, timerValues):
        known = self.count.get()
        hits = (known[0] if known else 0) + sum(len(pdf) for pdf in rows)
        self.count.update((hits,))
        if known is None:
            self.handle.registerTimer((key[1] + 1) * SLOT_MS + self.keep_ms)
        yield self._row(key, hits)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.count.clear()
        yield self._row(key, 0)

    def close(self) -> None:
        pass


def live_hits(events: DataFrame, key: str, days: int = 7, late: str = "1 hour") -> DataFrame:
    """(key, slot, hits) of a stream of events (ts, key), in update mode: an hour's count whenever it changes, and 0 when the watermark is ``days`` past its end.

    ``slot`` is the number of the hour since 1970 in UTC. What comes later than the watermark is dropped. Events without ts or key are left out. Start the stream
    within ``rocks``; ``current`` gives the counts by key from the rows that were written.
    """
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col(key).cast("string").alias("key")).where("ts is not null and key is not null")
    rows = rows.withWatermark("ts", late).withColumn("slot", F.floor(F.unix_millis("ts") / SLOT_MS).cast("long"))
    return rows.groupBy("key", "slot").transformWithStateInPandas(_Live(days * DAY_MS), "key string, slot long, hits long", "Update", "EventTime")


def current(updates: DataFrame) -> DataFrame:
    """(key, hits) of keys with hits, by the last update (``_batch``; of one batch the expiry) of each hour."""
    last = updates.groupBy("key", "slot").agg(F.max_by("hits", F.struct("_batch", -F.col("hits"))).alias("hits"))
    return last.groupBy("key").agg(F.sum("hits").alias("hits")).where("hits > 0")


def run_to_end(stream: DataFrame, where: str, mode: str) -> DataFrame:
    """Runs a stateful stream over what is there now and gives all its rows so far with ``_batch``; what lies in ``where`` (state and rows) is gone on from."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows/_batch={number}")

    with rocks(spark):
        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    return spark.read.schema(schema).option("basePath", f"{where}/rows").parquet(f"{where}/rows/_batch=*")
