"""Corpus pipeline: quality classifier, near-dedup, PII redaction, packing.

Each stage takes what its predecessor kept. All but the last return the columns of ``documents``; the last returns the batches.
Rows that repeat a doc_id pass each stage by themselves: near-dedup keeps one row of each group of near texts, whatever their ids.
Rows without a doc_id are in no group and stay.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.llm.common import stored, table
from lorespark.llm.near_dedup import near_duplicates
from lorespark.llm.packing import pack
from lorespark.llm.pii import redact
from lorespark.llm.quality import accepted, train


def quality(spark, docs, sf_dir):
    """Documents that the factorisation machine rejects go."""
    return accepted(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: the one of the smallest doc_id.

    Where a doc_id repeats, its rows are linked one by one, so that a row goes only if its own text has a near copy that stays.
    """
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = near_duplicates(docs, k=5, percent=80).where("kept and doc_id is not null").select("doc_id")
        return known.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = stored(known.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), k=5, percent=80).select(F.col("doc_id").alias(row), "component_id")
    first = groups.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct("doc_id", row)).alias("first")).select(F.col(f"first.{row}").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def pii(spark, docs, sf_dir):
    """Base and discovered personal data is replaced by its kind in brackets."""
    return redact(docs)


def packing(spark, docs, sf_dir):
    """Every document gets its place in a batch of its length bucket."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]
#: A trained model and dynamic programming are beyond SQL; tests/llm/ holds brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages on ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
