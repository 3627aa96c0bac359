"""Line analytics: offsets, fences, headings, line numbers, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T

CONTEXT = 40
CONTEXT_LIMIT = 200


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, text, start, in_fence): each line with its number from 1, its code-point offset and whether a fence holds it.

    Offsets and fences are running sums within a document; a document's lines meet in one task, its text would anyway.
    """
    rows = docs.select("doc_id", F.posexplode(F.split(T.normalize_newlines("text"), "\n", -1)).alias("_i", "text"))
    before = Window.partitionBy("doc_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("doc_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    fences = F.sum(F.col("text").rlike(r"^\s*(```|~~~)").cast("int")).over(upto)
    return rows.select("doc_id", (F.col("_i") + 1).cast("long").alias("line"), "text", start.alias("start"), (fences % 2 == 1).alias("in_fence"))


def headings(lined: DataFrame) -> DataFrame:
    """(doc_id, line, level, title, path) of each heading outside fences; the path joins the open titles by `` › ``.

    Of each level the last title counts that came after the last heading above that level.
    """
    shape = r"^(#{1,6})\s+(.*)$"
    rows = lined.where(~F.col("in_fence") & F.col("text").rlike(shape))
    rows = rows.select("doc_id", "line", F.length(F.regexp_extract("text", shape, 1)).alias("level"), F.trim(F.regexp_extract("text", shape, 2)).alias("title"))
    upto = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = []
    for n in range(1, 7):
        last = F.max(F.when(F.col("level") == n, F.struct("line", "title"))).over(upto)
        above = F.coalesce(F.max(F.when(F.col("level") < n, F.col("line"))).over(upto), F.lit(0))
        parts.append(F.when((last["line"] > above) & (n <= F.col("level")), last["title"]))
    return rows.withColumn("path", F.concat_ws(" › ", *parts))


def citation(docs: DataFrame, cited: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(doc_id, line, text, is_cited, in_chunk): lines around each citation (doc_id, line, char_start, char_end).

    The line is clamped to the document's, the context to 0..200 lines; ``in_chunk`` takes the end as inside. Unknown documents give no rows.
    """
    around = max(0, min(CONTEXT_LIMIT, context))
    split = F.split(T.normalize_newlines("text"), "\n", -1)
    wanted = cited.select("doc_id", F.col("line").alias("_cited"), F.col("char_start").alias("_from"), F.col("char_end").alias("_to"))
    rows = docs.select("doc_id", split.alias("_lines")).join(wanted, "doc_id").withColumn("_cited", F.least(F.greatest(F.col("_cited"), F.lit(1)), F.size("_lines")))
    first = F.greatest(F.col("_cited") - around, F.lit(1))
    shown = F.slice("_lines", first.cast("int"), (F.least(F.col("_cited") + around, F.size("_lines")) - first + 1).cast("int"))
    skipped = F.aggregate(F.slice("_lines", F.lit(1), (first - 1).cast("int")), F.lit(0).cast("long"), lambda s, x: s + F.length(x) + 1)
    rows = rows.select("doc_id", "_cited", "_from", "_to", first.alias("_first"), skipped.alias("_skipped"), F.posexplode(shown).alias("_i", "text"))
    key = Window.partitionBy("doc_id", "_cited", "_from", "_to").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_skipped") + F.coalesce(F.sum(F.length("text") + 1).over(key), F.lit(0))
    rows = rows.withColumn("_start", start).withColumn("line", (F.col("_first") + F.col("_i")).cast("long"))
    inside = (F.col("_start") <= F.col("_to")) & (F.col("_start") + F.length("text") >= F.col("_from"))
    return rows.select("doc_id", "line", "text", (F.col("line") == F.col("_cited")).alias("is_cited"), inside.alias("in_chunk"))
