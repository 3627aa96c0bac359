"""Evidence for a chunking policy: what a setting kept, dropped, cut or shared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest(docs: DataFrame) -> DataFrame:
    """The document with most characters, the smallest id among equals, found by one aggregate."""
    best = F.max_by(F.struct("doc_id", "text"), F.struct(F.length("text").alias("n"), (-F.col("doc_id")).alias("i")))
    return docs.where("text is not null").agg(best.alias("d")).select("d.doc_id", "d.text")


def discarded(relaxed: DataFrame, kept: DataFrame) -> DataFrame:
    """Chunks of a run without minimum that the run with it lacks, matched by their start."""
    return relaxed.join(kept.select("doc_id", "char_start"), ["doc_id", "char_start"], "left_anti")


#: Characters of a stretch of a document; what meets, meets within one, so that a long document isn't one key of a join.
STRETCH = 4096


def _stretch(place):
    return F.floor(place / STRETCH)


def _stretches(start: str, end: str):
    """The stretches that a span lies in, its end included."""
    return F.explode(F.sequence(_stretch(F.col(start)), _stretch(F.greatest(start, end))))


def contained(ranges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranges (doc_id, start, end) that lie whole inside a chunk of their document."""
    c = chunks.select(F.col("doc_id").alias("_doc"), "char_start", "char_end", _stretches("char_start", "char_end").alias("_at"))
    inside = (F.col("doc_id") == F.col("_doc")) & (_stretch(F.col("start")) == F.col("_at")) & (F.col("start") >= F.col("char_start")) & (F.col("end") <= F.col("char_end"))
    return ranges.join(c, inside, "left_semi")


def overlap_lengths(ranges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, covered): characters that ranges and chunks have in common, summed over the pairs that meet.

    A pair counts in the stretch where its later start lies.
    """
    r = ranges.select("doc_id", "start", "end", _stretches("start", "end").alias("_at"))
    c = chunks.select("doc_id", "char_start", "char_end", _stretches("char_start", "char_end").alias("_at"))
    once = _stretch(F.greatest("start", "char_start")) == F.col("_at")
    pairs = r.join(c, ["doc_id", "_at"]).where(once & (F.col("start") < F.col("char_end")) & (F.col("end") > F.col("char_start")))
    return pairs.groupBy("doc_id").agg(F.sum(F.least("end", "char_end") - F.greatest("start", "char_start")).cast("long").alias("covered"))


def policy_checks(chunks: DataFrame, chunk_tokens: int, overlap_tokens: int, min_chunk_tokens: int) -> DataFrame:
    """(check, ok, measured): one aggregate over all chunks, laid out as rows."""
    last = F.col("ordinal") == 0
    facts = chunks.agg(
        F.count("*").alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least"),
        F.count_if(F.col("overlap_tokens") > 0).alias("sharing"), F.count_if(~last).alias("followers"),
        F.count_if(F.col("heading").isNotNull()).alias("headed"), F.max("overlap_tokens").alias("widest"),
    )
    row = lambda name, ok, measured: F.struct(F.lit(name).alias("check"), F.coalesce(ok, F.lit(True)).alias("ok"), F.coalesce(measured, F.lit(0)).cast("long").alias("measured"))
    rows = F.array(
        row("chunks", F.col("n") > 0, F.col("n")),
        row("budget", F.col("most") <= chunk_tokens, F.col("most")),
        row("minimum", F.col("least") >= min_chunk_tokens, F.col("least")),
        row("overlap", (F.lit(overlap_tokens) == 0) | (F.col("followers") == 0) | (F.col("sharing") > 0), F.col("sharing")),
        row("overlap_size", F.col("widest") <= chunk_tokens, F.col("widest")),
        row("headings", F.lit(True), F.col("headed")),
    )
    return facts.select(F.explode(rows).alias("r")).select("r.check", "r.ok", "r.measured")
