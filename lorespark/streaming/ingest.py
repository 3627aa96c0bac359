"""Document ingestion as a stream: each micro-batch is chunked and committed to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators.chunking import Config, chunk_documents
from lorespark.sources import snapshots
from lorespark.sources.store import Store
from lorespark.streaming import state


def publish_stream(documents: DataFrame, root: str, checkpoint: str, config: Config = Config(), skip_unchanged: bool = False):
    """A running query that keeps the chunks in the store at ``root`` (table ``rows``) up to date with a stream of documents (doc_id, text).

    A batch writes its documents' chunks and the keys of what they replace, nothing else; of several rows of a doc_id the last counts, by a column ``at`` if there
    is one, then by the text. The batch's number is in the same commit as its rows, so a batch that is run again after a failure publishes nothing twice.
    With ``skip_unchanged`` the stream keeps a digest of each document, and one that comes again with the same text is neither chunked nor written.
    """

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        t = Store(spark, root).begin()
        if t.meta.get("batch") == number:
            return
        order = F.struct(*(["at"] if "at" in batch.columns else []), "text")
        latest = snapshots.kept(batch.groupBy("doc_id").agg(F.max_by("text", order).alias("text")), "ingest")
        if skip_unchanged and latest.isEmpty():
            return
        t.upsert("rows", chunk_documents(latest, config), "doc_id", changed=latest.select("doc_id"))
        t.commit(batch=number)

    rows = state.changed_documents(documents) if skip_unchanged else documents
    writer = rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    if not skip_unchanged:
        return writer.start()
    with state.rocks(documents.sparkSession):
        return writer.start()
