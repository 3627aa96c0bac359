"""One bound for what Spark hands to Python at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of an Arrow batch of texts, files or vectors; a batch must fit into a Python worker whatever its rows hold.
BATCH_BYTES = 8 << 20


def bounded(rows: DataFrame) -> DataFrame:
    """``rows``, whose session bounds Arrow batches by bytes from here on. Every stage that goes to Python asks for it, so that none depends on what ran before."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows
