"""Catalog analytics over collections, documents and hit events. Every function is a DataFrame in, a DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T

#: Bytes of a vector component by quantizer (fixed values).
QUANTIZERS = {"none": 4.0, "FP16": 2.0, "INT8": 1.0, "INT4": 0.5}
CHUNKS_PER_SECOND = 40
WARN_AT = 0.9
MAX_UPLOAD = 32 * 1024 * 1024


def summary(documents: DataFrame, key: str = "collection") -> DataFrame:
    """Counts by status and the sum of chunks (unknown counts as none) of each collection."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return documents.groupBy(key).agg(F.count("*").alias("documents"), of("ready"), of("pending"), of("failed"), F.sum(F.coalesce("chunks", F.lit(0))).cast("long").alias("chunks"))


def view(collections: DataFrame, summaries: DataFrame, key: str = "collection") -> DataFrame:
    """Collections with their summary and status: pending until built, failed if a document failed, else ready."""
    rows = collections.join(summaries, key, "left")
    status = F.when(F.col("built_at").isNull(), "pending").when(F.coalesce("failed", F.lit(0)) > 0, "failed").otherwise("ready")
    return rows.withColumn("status", status)


def builds(collections: DataFrame) -> DataFrame:
    """Built collections, the latest first."""
    return collections.where("built_at is not null").orderBy(F.desc("built_at"), "collection")


def cost(totals: DataFrame, dimension: int, quantizer: str) -> DataFrame:
    """Bytes, seconds and compression that embedding ``chunks`` would take."""
    per = QUANTIZERS[quantizer]
    n = F.col("chunks")
    return (
        totals.withColumn("raw_bytes", (n * dimension * 4).cast("long"))
        .withColumn("vector_bytes", F.floor(n * dimension * per + 0.5).cast("long"))
        .withColumn("seconds", F.greatest(F.lit(1), F.floor(n / CHUNKS_PER_SECOND + 0.5)).cast("long"))
        .withColumn("compression", F.lit(4.0 / per))
    )


def scope(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def parser_summary(documents: DataFrame, key: str = "collection") -> DataFrame:
    """Sorted distinct converters and structures, joined by commas."""
    joined = lambda c, none: F.array_join(F.array_sort(F.collect_set(F.coalesce(c, F.lit(none)))), ",")
    return documents.groupBy(key).agg(joined("converter", "verbatim").alias("converters"), joined("structure", "unparsed").alias("structures"))


def quota(files: DataFrame, limit: int | None, warn_at: float = WARN_AT) -> DataFrame:
    """Used bytes against a limit; no limit gives no fraction and never warns."""
    used = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("used"))
    fraction = F.col("used") / F.lit(limit) if limit else F.lit(None).cast("double")
    rows = used.withColumn("limit", F.lit(limit).cast("long")).withColumn("fraction", fraction)
    reached = lambda x: F.coalesce(F.col("fraction") >= x, F.lit(False))
    return rows.withColumn("near_limit", reached(warn_at)).withColumn("exceeded", reached(1.0))


def admission(used, incoming, limit) -> Column:
    """Struct (ok, shortfall): whether incoming bytes still fit; use that couldn't be measured is let in."""
    over = F.greatest(used + incoming - limit, F.lit(0))
    return F.struct(F.coalesce(over == 0, F.lit(True)).alias("ok"), F.coalesce(over, F.lit(0)).cast("long").alias("shortfall"))


def hits_in_window(events: DataFrame, now: Column, days: int, key: str) -> DataFrame:
    """Hits (ts, hits) of each key in the last days up to ``now``."""
    recent = events.where((F.col("ts") > now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= now))
    return recent.groupBy(key).agg(F.sum("hits").cast("long").alias("hits"))


def sliding_hits(daily: DataFrame, days: int, key: str) -> DataFrame:
    """Of each key and day (key, day, hits), the hits of the last ``days`` days.

    Days are dense integers, so a range frame reads only the rows it sums.
    """
    frame = Window.partitionBy(key).orderBy("_n").rangeBetween(-(days - 1), 0)
    rows = daily.withColumn("_n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    return rows.withColumn("hits_window", F.sum("hits").over(frame).cast("long")).drop("_n")


def reconcile(documents: DataFrame, snapshots: DataFrame, key: str = "collection") -> DataFrame:
    """Chunks by the documents' records against the served snapshot's count, and the difference."""
    left = documents.groupBy(key).agg(F.sum(F.coalesce("chunks", F.lit(0))).cast("long").alias("recorded"))
    rows = left.join(snapshots.select(key, F.col("chunks").alias("served")), key, "full_outer")
    return rows.select(key, F.coalesce("recorded", F.lit(0)).alias("recorded"), F.coalesce("served", F.lit(0)).alias("served")).withColumn("difference", F.col("recorded") - F.col("served"))


def not_served(documents: DataFrame, collections: DataFrame, key: str = "collection") -> DataFrame:
    """Documents that the served snapshot lacks: its collection is unbuilt, or they were built later, or have no chunks."""
    rows = documents.join(collections.select(key, F.col("built_at").alias("_built")), key, "left")
    return rows.where(F.col("_built").isNull() | (F.col("built_at") > F.col("_built")) | (F.coalesce("chunks", F.lit(0)) == 0)).drop("_built")


def chunk_rows(rows: DataFrame) -> DataFrame:
    """Rows as chunks are served: those without a document or a text go, missing numbers are 0."""
    kept = rows.where("doc_id is not null and text is not null")
    return kept.select("doc_id", "text", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("ordinal", "tokens", "char_start", "char_end")])


def changed(now: DataFrame, recorded: DataFrame, key: str = "collection") -> DataFrame:
    """(key, changed): whether anything of a collection's row differs from the recorded one; nulls equal nulls, a missing row is a change."""
    rest = [c for c in now.columns if c != key]
    side = lambda df, name: df.select(key, F.struct(*rest).alias(name), F.lit(True).alias(f"has{name}"))
    rows = side(now, "_a").join(side(recorded, "_b"), key, "full_outer")
    same = F.coalesce(F.col("has_a") & F.col("has_b"), F.lit(False)) & F.col("_a").eqNullSafe(F.col("_b"))
    return rows.select(key, (~same).alias("changed"))


def heaviest(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, value): the value of most weight of each key, the least among equals."""
    sums = rows.groupBy(key, value).agg(F.sum(weight).alias("_w"))
    best = sums.groupBy(key).agg(F.max("_w").alias("_w"))
    return sums.join(best, [key, "_w"]).groupBy(key).agg(F.min(value).alias(value))


def merged_records(current: DataFrame, built: DataFrame) -> DataFrame:
    """Records after a build (doc_id, status, chunks): built ones are ready with their counts, failed ones stay so, unknown ones are added."""
    b = built.select("doc_id", F.col("status").alias("_status"), F.col("chunks").alias("_chunks"))
    rows = current.join(b, "doc_id", "full_outer")
    status = F.when(F.col("status") == "failed", "failed").otherwise(F.coalesce("_status", "status"))
    return rows.select("doc_id", status.alias("status"), F.coalesce("_chunks", "chunks").alias("chunks"))


def pending_documents(documents: DataFrame, incremental: bool) -> DataFrame:
    """What a build must embed: documents that aren't ready; an incremental one leaves out converted ones that failed."""
    rows = documents.where(F.coalesce("status", F.lit("")) != "ready")
    return rows.where(~((F.col("status") == "failed") & F.col("converter").isNotNull())) if incremental else rows


def upload_verdict(name, size) -> Column:
    """Null for an upload that's taken, else the reason it isn't."""
    return (
        F.when(T.format_of(name) == "unsupported", "unsupported file type")
        .when(F.coalesce(size, F.lit(0)) < 1, "file is empty")
        .when(size > MAX_UPLOAD, F.concat(F.lit("file is over "), T.format_bytes(F.lit(MAX_UPLOAD))))
    )


def candidates(collections: DataFrame, query: str) -> DataFrame:
    """Collections whose name or id holds the query, case aside; built ones first."""
    q = query.strip().lower()
    rows = collections.where(F.lower("name").contains(q) | F.lower("collection").contains(q))
    return rows.orderBy(F.desc(F.col("built_at").isNotNull()), "collection")


def resolve(collections: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, status, collection) for each request: an exact id, else an exact name, else the only prefix of either.

    Case and outer blanks don't matter; a quoted part stands for the whole. The catalog is small and is read per request as a join
    on equality or prefix, and the best tier of matches decides: one is ``ok``, more are ``ambiguous``.
    """
    asked = wanted.select("wanted").distinct()
    quoted = F.regexp_extract("wanted", "[\"'“‘「《]([^\"'”’」》]+)[\"'”’」》]", 1)
    asked = asked.withColumn("_q", F.lower(F.trim(F.when(quoted != "", quoted).otherwise(F.coalesce("wanted", F.lit(""))))))
    c = collections.select("collection", F.lower("collection").alias("_id"), F.lower(F.trim("name")).alias("_name"))
    tier = (
        F.when(F.col("_id") == F.col("_q"), 1).when(F.col("_name") == F.col("_q"), 2)
        .when(F.col("_id").startswith(F.col("_q")) | F.col("_name").startswith(F.col("_q")), 3)
    )
    matches = asked.where("_q <> ''").join(c, tier.isNotNull()).select("wanted", "collection", tier.alias("_tier"))
    best = matches.withColumn("_best", F.min("_tier").over(Window.partitionBy("wanted"))).where("_tier = _best")
    found = best.groupBy("wanted").agg(F.count("*").alias("_n"), F.min("collection").alias("_c"))
    rows = asked.join(found, "wanted", "left")
    status = F.when(F.col("_q") == "", "empty").when(F.col("_n").isNull(), "not_found").when(F.col("_n") > 1, "ambiguous").otherwise("ok")
    return rows.select("wanted", status.alias("status"), F.when(status == "ok", F.col("_c")).alias("collection"))


def progress(log: DataFrame, key: str = "job") -> DataFrame:
    """Log rows (job, at, processed, total) with the largest fraction reached so far: progress never runs back."""
    upto = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.when(F.col("total") > 0, F.least(F.col("processed") / F.col("total"), F.lit(1.0))).otherwise(0.0)
    return log.withColumn("fraction", F.max(share).over(upto))


def overview(views: DataFrame) -> DataFrame:
    return views.agg(F.coalesce(F.sum("documents"), F.lit(0)).cast("long").alias("documents"), F.count_if(F.col("status") == "ready").alias("ready"), F.count("*").alias("collections"))


def build_records(views: DataFrame) -> DataFrame:
    """(at, collection, chunks, status) of every collection that was ever built, the latest first."""
    rows = views.where("built_at is not null")
    return rows.select(F.col("built_at").alias("at"), "collection", "chunks", "status").orderBy(F.desc("at"), "collection")


def document_list(documents: DataFrame) -> DataFrame:
    """What a list of documents shows, the largest id first; unknown chunk counts stay null."""
    shown = [c for c in ("doc_id", "name", "bytes", "status", "chunks", "error", "structure") if c in documents.columns]
    return documents.select(*shown, T.extension("name").alias("extension")).orderBy(F.desc("doc_id"))


def matching(rows: DataFrame, status: str = "all", text: str = "", columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Rows of a status (``all``: any) whose ``columns`` hold the text, case and outer blanks aside."""
    needle = text.strip().lower()
    rows = rows if status == "all" else rows.where(F.col("status") == status)
    if not needle:
        return rows
    holds = F.lit(False)
    for c in columns:
        holds = holds | F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    return rows.where(holds)


def first_preview(chunks: DataFrame, n: int = 8) -> DataFrame:
    """The first n chunks of the first document that has any, by one aggregate and a pruned scan."""
    first = chunks.agg(F.min("doc_id").alias("doc_id"))
    rows = chunks.where(F.col("ordinal") < n).join(F.broadcast(first), "doc_id", "left_semi")
    return rows.select("doc_id", "ordinal", "tokens", "overlap_tokens", T.preview("text", 80).alias("snippet"), "char_start", "char_end")


def inspection(documents: DataFrame, collections: DataFrame, snapshots: DataFrame, key: str = "collection") -> DataFrame:
    """One row of a read-only report for each collection: counts by status, chunks recorded and served, documents not served."""
    missing = not_served(documents, collections, key).groupBy(key).agg(F.count("*").alias("not_served"))
    rows = view(collections, summary(documents, key), key).join(reconcile(documents, snapshots, key).select(key, "served", "difference"), key, "left")
    return rows.join(missing, key, "left").withColumn("not_served", F.coalesce("not_served", F.lit(0)))
