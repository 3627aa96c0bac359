"""Named queries over the driver's tables, each with the SQL that gives the same rows.

The tables stand in for a store: ``documents`` are uploads whose ``source`` is the collection, ``labels`` tell their status (1 ready,
0 failed, none pending), ``embeddings`` are chunk vectors under the document's id, ``events`` are hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import catalog, chunking, convert, embed, evidence, lines, retrieval, vector_index
from lorespark.plans import oracle as O

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _chunks(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    texts = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return vectors, texts


def _twentieths(spark, sf_dir):
    """Every vector whose id is divisible by 20 as a query."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _asked(spark, sf_dir):
    """Every 20th vector with the first three words of the document of its id."""
    words = _docs(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(T.search_tokens("text"), 1, 3), " ").alias("text"))
    return _twentieths(spark, sf_dir).join(words, "query_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def _records(spark, sf_dir):
    """Document records: (doc_id, collection, name, status, chunks, bytes, converter, structure)."""
    status = F.when(F.col("quality") == 1, "ready").when(F.col("quality") == 0, "failed").otherwise("pending")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = _docs(spark, sf_dir).join(labels, "doc_id", "left").withColumn("status", status)
    return rows.select(
        "doc_id", F.col("source").alias("collection"), F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("name"), "status",
        F.when(F.col("status") == "ready", F.ceil(F.col("n_chars") / 1000)).cast("long").alias("chunks"), F.octet_length("text").cast("long").alias("bytes"),
        F.when(F.col("toxic") == 1, "html").alias("converter"), F.when(F.col("quality") == 1, "structured").when(F.col("quality") == 0, "flat-text").alias("structure"),
    )


def _collections(spark, sf_dir):
    """Catalog rows (collection, name, built_at): a collection is built when its least document is labelled."""
    rows = _records(spark, sf_dir).groupBy("collection").agg(F.min_by("status", "doc_id").alias("s"), F.min("doc_id").alias("i"))
    built = F.when(F.col("s") != "pending", F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("i").cast("int")))
    return rows.select("collection", F.concat(F.lit("Library "), "collection").alias("name"), built.alias("built_at"))


def _hybrid(spark, sf_dir):
    vectors, texts = _chunks(spark, sf_dir)
    return vectors.join(texts, "id", "full_outer"), _asked(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search for one query, hits with their documents."""
    return hybrid_with_documents(spark, sf_dir)


# Retrieval


@query(O.DENSE_TOPK)
def dense_topk(spark, sf_dir):
    vectors, _ = _chunks(spark, sf_dir)
    hits = retrieval.floored(retrieval.dense(vectors, _twentieths(spark, sf_dir), 8), 0.2)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"), T.confidence_band("score").alias("band"))


@query(O.DENSE_BELOW_FLOOR)
def dense_below_floor(spark, sf_dir):
    vectors, _ = _chunks(spark, sf_dir)
    return retrieval.dense(vectors, _twentieths(spark, sf_dir), 100).groupBy("query_id").agg(F.count_if(F.col("score") < 0.2).alias("below_floor"), F.count_if(F.col("score") >= 0.2).alias("kept"))


@query(O.FTS_BM25_TOPK)
def fts_bm25_topk(spark, sf_dir):
    _, texts = _chunks(spark, sf_dir)
    hits = retrieval.bm25(texts, _asked(spark, sf_dir), 20)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(O.POSTINGS)
def fts_postings(spark, sf_dir):
    """The inverted index, summed up by term: documents and occurrences."""
    _, texts = _chunks(spark, sf_dir)
    return retrieval.postings(texts).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("occurrences"))


@query(O.HYBRID_RRF_TOPK)
def hybrid_rrf_topk(spark, sf_dir):
    joined, asked = _hybrid(spark, sf_dir)
    hits = retrieval.hybrid(joined, asked, topk=20, min_score=0.2)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "band", "dense_rank", "fts_rank")


@query(O.HYBRID_STATS)
def hybrid_stats(spark, sf_dir):
    joined, asked = _hybrid(spark, sf_dir)
    return retrieval.search_stats(joined, asked, min_score=0.2)


@query(O.HYBRID_WITH_DOCUMENTS)
def hybrid_with_documents(spark, sf_dir):
    joined, asked = _hybrid(spark, sf_dir)
    hits = retrieval.hybrid(joined, asked, topk=8, min_score=0.2)
    named = retrieval.with_documents(hits, _docs(spark, sf_dir).select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("name"), "text"))
    return named.select("query_id", "rank", "id", "name", F.round("score", 4).alias("match_score"), "band")


@query(O.QUANTIZED_TOPK)
def quantized_topk(spark, sf_dir):
    """INT8 codes, rescored."""
    vectors, _ = _chunks(spark, sf_dir)
    return vector_index.rescored(vectors, _twentieths(spark, sf_dir), 8).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(O.HASH_EMBED_NORM)
def hash_embedding(spark, sf_dir):
    """Bigram-hash embeddings as (bucket, count) rows: non-zero buckets and squared length of each document's vector."""
    squares = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n * n)
    return embed.bigram_buckets(_docs(spark, sf_dir)).select("doc_id", F.size("buckets").cast("long").alias("buckets"), squares.alias("squared_length"))


# Tokens and chunks


@query(O.TOKEN_ESTIMATE)
def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.token_estimate("text").alias("tokens"))


def _markdown(spark, sf_dir):
    """Documents with a heading of their source before the body."""
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n## "), "lang", F.lit("\n\n"), "text").alias("text"))


@query()
def chunk_heading(spark, sf_dir):
    return chunking.chunk_documents(_markdown(spark, sf_dir), chunking.Config("heading", 200, 12, 5))


@query()
def chunk_fixed(spark, sf_dir):
    return chunking.chunk_documents(_docs(spark, sf_dir), chunking.Config("fixed", 512, 64, 1))


@query(O.CHUNK_PARAGRAPH)
def chunk_paragraph(spark, sf_dir):
    """Paragraphs where none is over the budget: their count and tokens by document."""
    chunks = chunking.chunk_documents(_docs(spark, sf_dir), chunking.Config("paragraph", 1_000_000, 0, 0))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("tokens").cast("long").alias("tokens"))


@query(O.CHUNK_WINDOWS)
def chunk_window_count(spark, sf_dir):
    """Windows of a text without places to cut: the least number that covers it at the given overlap."""
    plain = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"[.\n。]", " ").alias("text"))
    chunks = chunking.chunk_documents(plain, chunking.Config("fixed", 200, 50, 0))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("overlap_tokens").cast("long").alias("overlap_tokens"))


@query(O.CHUNK_OVERLAP)
def chunk_overlap(spark, sf_dir):
    """Overlaps of windows laid every 700 characters, 800 long."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 700) - 1, F.lit(0)))
    rows = _docs(spark, sf_dir).select("doc_id", F.length("text").alias("n"), F.posexplode(steps).alias("ordinal", "_k"))
    rows = rows.select("doc_id", "ordinal", (F.col("_k") * 700).cast("long").alias("char_start"), F.least(F.col("_k") * 700 + 800, F.col("n")).cast("long").alias("char_end"))
    return chunking.overlaps(rows).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("overlap_chars").cast("long").alias("overlap_chars"))


@query(O.BUILD_PLAN)
def build_plan(spark, sf_dir):
    """Totals of a plan over windows of 1000 characters, by document and in all."""
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 1000) - 1, F.lit(0)))).alias("_k"), "text")
    piece = F.substring("text", (F.col("_k") * 1000 + 1).cast("int"), F.lit(1000))
    chunks = rows.select("doc_id", T.token_estimate(piece).alias("tokens"), F.lit(0).cast("long").alias("overlap_tokens"), F.lit(0).cast("long").alias("discarded"))
    return chunking.plan_totals(chunks).select("doc_id", "chunks", "tokens", "average_tokens")


@query(O.COST_ESTIMATE)
def cost_estimate(spark, sf_dir):
    totals = _records(spark, sf_dir).groupBy("collection").agg(F.sum(F.coalesce("chunks", F.lit(0))).cast("long").alias("chunks"))
    return catalog.cost(totals, 1024, "INT8")


# Lines and citations


@query(O.LINE_OFFSETS)
def line_offsets(spark, sf_dir):
    return lines.lines(_docs(spark, sf_dir)).select("doc_id", "line", "start", F.length("text").cast("long").alias("length"))


@query(O.FENCE_PARITY)
def fence_parity(spark, sf_dir):
    """Every ninth line of a document made a fence: lines inside and outside."""
    marked = _docs(spark, sf_dir).select("doc_id", F.concat_ws("\n", F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 9 == 4, F.lit("```")).otherwise(x))).alias("text"))
    return lines.lines(marked).groupBy("doc_id").agg(F.count_if("in_fence").alias("inside"), F.count_if(~F.col("in_fence")).alias("outside"))


@query(O.HEADING_PATHS)
def heading_paths(spark, sf_dir):
    return lines.headings(lines.lines(_markdown(spark, sf_dir))).select("doc_id", "line", F.col("level").cast("long").alias("level"), "title", "path")


@query(O.LINE_OF_OFFSET)
def line_of_offset(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.line_of("text", F.lit(500)).alias("line"))


@query(O.CITATION_WINDOW)
def citation_window(spark, sf_dir):
    """Two lines around the line of each document's 300th character."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    cited = docs.select("doc_id", T.line_of("text", F.lit(300)).alias("line"), F.lit(250).alias("char_start"), F.lit(350).alias("char_end"))
    return lines.citation(docs, cited, 2)


# Catalog


@query(O.DOCUMENT_SUMMARY)
def document_summary(spark, sf_dir):
    return catalog.summary(_records(spark, sf_dir))


@query(O.COLLECTION_VIEW)
def collection_view(spark, sf_dir):
    rows = catalog.view(_collections(spark, sf_dir), catalog.summary(_records(spark, sf_dir)))
    return rows.select("collection", "name", "status", "documents", "chunks")


@query(O.OVERVIEW)
def overview_totals(spark, sf_dir):
    return catalog.overview(catalog.view(_collections(spark, sf_dir), catalog.summary(_records(spark, sf_dir))))


@query(O.PARSER_SUMMARY)
def parser_summary(spark, sf_dir):
    return catalog.parser_summary(_records(spark, sf_dir))


@query(O.BUILD_SCOPE)
def build_scope(spark, sf_dir):
    return catalog.scope(catalog.pending_documents(_records(spark, sf_dir), incremental=True))


@query(O.QUOTA)
def quota_state(spark, sf_dir):
    return catalog.quota(_records(spark, sf_dir), 5_000_000).select("used", "limit", F.round("fraction", 6).alias("fraction"), "near_limit", "exceeded")


@query(O.RECONCILE)
def reconcile_chunks(spark, sf_dir):
    snapshots = _docs(spark, sf_dir).groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("chunks"))
    return catalog.reconcile(_records(spark, sf_dir), snapshots)


@query(O.NOT_SERVED)
def not_served_documents(spark, sf_dir):
    records = _records(spark, sf_dir).withColumn("built_at", F.lit("2024-01-05").cast("timestamp"))
    return catalog.not_served(records, _collections(spark, sf_dir)).select("doc_id", "collection")


@query(O.MERGE_RECORDS)
def merge_full_outer(spark, sf_dir):
    built = table(spark, sf_dir, "labels").select((F.col("doc_id") + 100).alias("doc_id"), F.lit("ready").alias("status"), (F.col("quality") + 1).cast("long").alias("chunks"))
    return catalog.merged_records(_records(spark, sf_dir).select("doc_id", "status", "chunks"), built)


@query(O.UPLOAD_VERDICTS)
def upload_verdicts(spark, sf_dir):
    """Verdict on each page's address taken as a file name."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("name"), F.octet_length("html").alias("size"))
    return rows.select("page_id", T.extension("name").alias("extension"), T.format_of("name").alias("format"), catalog.upload_verdict("name", F.col("size")).alias("reason"))


@query(O.RESOLVE)
def resolve_collection(spark, sf_dir):
    wanted = ["src1", " SRC1 ", "library src2", "src", "lib", "look in “src3” please", "", "  ", "nothing", "Library src1"]
    asked = spark.createDataFrame([(w,) for w in wanted], "wanted string")
    return catalog.resolve(_collections(spark, sf_dir), asked)


@query(O.CANDIDATE_COLLECTIONS)
def candidate_collections(spark, sf_dir):
    return catalog.candidates(_collections(spark, sf_dir), "Src1").select("collection", "name", F.col("built_at").isNotNull().alias("built"))


@query(O.HITS_7D)
def hits_7d(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", "event_type", F.lit(1).alias("hits"))
    return catalog.hits_in_window(events, F.lit("2024-01-20").cast("timestamp"), 7, "event_type")


@query(O.HITS_SLIDING)
def hits_sliding(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("hits"))
    return catalog.sliding_hits(daily, 7, "event_type").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(O.PROGRESS)
def job_progress(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), (F.col("event_id") % 97).alias("processed"), F.lit(100).alias("total"))
    return catalog.progress(log).select("job", "at", F.round("fraction", 6).alias("fraction"))


# Evidence


def _ranges(spark, sf_dir):
    """Lines as ranges and windows of 400 characters as chunks."""
    ranges = lines.lines(_docs(spark, sf_dir)).select("doc_id", "start", (F.col("start") + F.length("text")).alias("end"))
    steps = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 400) - 1, F.lit(0))))
    chunks = _docs(spark, sf_dir).select("doc_id", F.length("text").alias("_n"), steps.alias("_k"))
    chunks = chunks.select("doc_id", (F.col("_k") * 400).cast("long").alias("char_start"), F.least(F.col("_k") * 400 + 400, F.col("_n")).cast("long").alias("char_end"))
    return ranges, chunks


@query(O.RETAINED_ROWS)
def retained_rows_semi(spark, sf_dir):
    return evidence.contained(*_ranges(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query(O.INTERVAL_OVERLAP)
def interval_overlap(spark, sf_dir):
    return evidence.overlap_lengths(*_ranges(spark, sf_dir))


@query(O.DISCARDED_ANTI)
def discarded_anti(spark, sf_dir):
    """Paragraphs of under 20 tokens: what a minimum of 20 drops."""
    relaxed = lines.lines(_docs(spark, sf_dir)).select("doc_id", F.col("start").alias("char_start"), "text")
    kept = relaxed.where(T.token_estimate("text") >= 20)
    return evidence.discarded(relaxed, kept).select("doc_id", "char_start", T.preview("text", 400).alias("text"))


@query(O.LONGEST)
def longest_document(spark, sf_dir):
    return evidence.longest(_docs(spark, sf_dir)).select("doc_id", F.length("text").cast("long").alias("chars"))


@query()
def policy_checks(spark, sf_dir):
    chunks = chunking.chunk_documents(_markdown(spark, sf_dir), chunking.Config("heading", 200, 12, 5))
    return evidence.policy_checks(chunks, 200, 12, 5)


# Converters


@query()
def html_to_markdown(spark, sf_dir):
    return convert.convert_html(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html")


@query(O.HTML_STRIP)
def html_strip_noncontent(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(convert.stripped_html("html")).cast("long").alias("chars"))


@query(O.UNSAFE_URLS)
def unsafe_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", convert.is_unsafe_url(F.concat(F.lit(" JavaScript:"), "url")).alias("unsafe"), convert.is_unsafe_url("url").alias("plain"))


@query(O.ROWS_TO_TABLE)
def rows_to_table(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("sheet"), F.col("n_nationkey").alias("row"), F.array(F.col("n_nationkey").cast("string"), "n_name", F.concat(F.lit("a|b"), "n_nationkey")).alias("cells"))
    return convert.rows_to_tables(rows, ["key", "name", "note"])


@query(O.JSON_WALK)
def json_props_walk(spark, sf_dir):
    return convert.walk_json(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props")


@query(O.STRUCTURE_GRADE)
def structure_grade(spark, sf_dir):
    table_part = F.when(F.col("doc_id") % 2 == 0, F.lit("\n| a | b |\n| --- | --- |\n| 1 | 2 |")).otherwise(F.lit(""))
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.lit("# t\n")), "text", table_part).alias("text"))
    return convert.grade(docs)


@query(O.DOC_IDS)
def doc_id_fnv1a(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fnv1a_id("source", F.col("doc_id").cast("string")).alias("id"))


@query(O.COLLECTION_IDS)
def collection_ids(spark, sf_dir):
    return _docs(spark, sf_dir).select("source").distinct().select("source", T.collection_domain("source").alias("domain"), T.is_collection_id(T.collection_id("source")).alias("valid"))


@query(O.CITATION_ADDRESS)
def citation_addresses(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", T.citation_address(F.lit("my lib/ä"), "url", F.col("page_id") + 1).alias("address"))
    return rows.select("page_id", "address", T.parsed_citation("address")["doc"].alias("doc"), T.parsed_citation("address")["line"].cast("long").alias("line"))


@query(O.FORMAT_BYTES)
def bytes_shown(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.format_bytes(F.octet_length("text") * F.col("doc_id")).alias("shown"))


@query(O.INCREMENTAL)
def incremental_union(spark, sf_dir):
    """Chunk counts after the failed documents' chunks are replaced: inherited rows and new ones."""
    from lorespark.sources import snapshots

    served = _docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("size"))
    failed = _records(spark, sf_dir).where("status = 'failed'").select("doc_id")
    fresh = served.join(failed, "doc_id", "left_semi").withColumn("size", F.col("size") * 2)
    return snapshots.replaced(served, fresh, "doc_id").agg(F.count("*").alias("rows"), F.sum("size").cast("long").alias("size"))


@query(O.STREAM_COUNTS)
def stream_window_counts(spark, sf_dir):
    """Hit counts by day from a stream over the events, run to its end."""
    from lorespark.streaming import hits

    return hits.run_to_end(spark, f"{sf_dir}/events.parquet", "1 day", "event_type")


# Lists and reports


def _views(spark, sf_dir):
    return catalog.view(_collections(spark, sf_dir), catalog.summary(_records(spark, sf_dir)))


@query(O.BUILD_RECORDS)
def build_records(spark, sf_dir):
    return catalog.build_records(_views(spark, sf_dir))


@query(O.DOCUMENT_LIST)
def document_list(spark, sf_dir):
    return catalog.document_list(_records(spark, sf_dir))


@query(O.FILTER_DOCUMENTS)
def filter_documents(spark, sf_dir):
    return catalog.matching(_records(spark, sf_dir), "ready", " SRC1/ ").select("doc_id", "name")


@query(O.FILTER_COLLECTIONS)
def filter_collections(spark, sf_dir):
    return catalog.matching(_views(spark, sf_dir), "all", "Src1", ("name", "collection")).select("collection", "name")


@query(O.INSPECTION)
def inspection(spark, sf_dir):
    records = _records(spark, sf_dir).withColumn("built_at", F.lit("2024-01-05").cast("timestamp"))
    served = _docs(spark, sf_dir).groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("chunks"))
    return catalog.inspection(records, _collections(spark, sf_dir), served).drop("name", "built_at")


@query(O.FIRST_PREVIEW)
def first_preview(spark, sf_dir):
    """Windows laid every 700 characters, 800 long, of the first document that has any."""
    docs = _docs(spark, sf_dir).where("length(text) > 0").select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.ceil(F.length("text") / 700) - 1)).alias("ordinal", "_k"))
    piece = F.substring("text", (F.col("_k") * 700 + 1).cast("int"), F.lit(800))
    chunks = docs.select(
        "doc_id", F.col("ordinal").cast("long").alias("ordinal"), piece.alias("text"), T.token_estimate(piece).alias("tokens"), F.lit(0).alias("overlap_tokens"),
        (F.col("_k") * 700).cast("long").alias("char_start"), F.least(F.col("_k") * 700 + 800, F.length("text")).cast("long").alias("char_end"),
    )
    return catalog.first_preview(chunks).drop("snippet", "overlap_tokens")


@query(O.CHUNK_COUNTS)
def chunks_by_document(spark, sf_dir):
    return _ranges(spark, sf_dir)[1].groupBy("doc_id").agg(F.count("*").alias("chunks"))


# Functions


@query(O.SOURCE_PATHS)
def source_paths(spark, sf_dir):
    absolute = F.concat(F.lit("/work/store/"), "source", F.lit("/doc_"), "doc_id", F.lit(".v1.md"))
    path = T.relative_path(F.lit("/work/"), absolute)
    return _docs(spark, sf_dir).select("doc_id", path.alias("path"), T.doc_id_of(path).alias("found"), T.doc_id_of(F.concat("source", F.lit("/readme.md"))).alias("other"))


@query(O.STAMPS)
def stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.stamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("shown"))


@query(O.HIT_LINES)
def hit_lines(spark, sf_dir):
    """Hits rendered as lines and read back."""
    score = F.lit(0.5) + F.col("doc_id") % 50 / 100
    rows = _docs(spark, sf_dir).select("doc_id", "n_chars", "text", score.alias("score"), F.concat("source", F.lit("/doc_"), "doc_id", F.lit(".md")).alias("name"))
    line = T.hit_line(F.lit(3), F.lit("fair"), "score", "name", (F.col("doc_id") + 1).cast("int"), F.lit(10), F.col("n_chars").cast("int"), F.coalesce("text", F.lit("")))
    found = rows.select("doc_id", T.parsed_hits(line)[0].alias("h"))
    return found.select("doc_id", "h.rank", "h.band", "h.score", "h.name", "h.line", "h.char_start", "h.char_end", F.col("h.doc_id").alias("found"))


@query(O.WIDE_TEXTS)
def wide_texts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.is_wide("text").alias("wide"))


@query(O.BUILD_ERRORS)
def build_errors(spark, sf_dir):
    n = F.col("event_id") % 3
    said = F.when(n == 0, "Collection is CLOSED now").when(n == 1, "can't lock the index").otherwise(F.concat(F.lit("event "), "event_id"))
    return table(spark, sf_dir, "events").select("event_id", T.build_error(said).alias("message"))


@query(O.STREAM_SLIDING)
def stream_sliding_hits(spark, sf_dir):
    """Hits of the seven days from each day on, from a stream run to its end."""
    from lorespark.streaming import hits

    return hits.run_to_end(spark, f"{sf_dir}/events.parquet", "7 days", "event_type", "1 day")


# Vector indexes


@query(O.QUANTIZED_CODES)
def quantized_codes(spark, sf_dir):
    """Sums of each vector's INT8 and INT4 codes."""
    vectors, _ = _chunks(spark, sf_dir)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    eight = vector_index.encoded(vectors.where("vector is not null"), "INT8").select("id", "size", total("codes").alias("int8"))
    four = vector_index.encoded(vectors.where("vector is not null"), "INT4")
    whole = vector_index.decoded(four, "INT4").join(four.select("id", "scale"), "id")
    return eight.join(whole.select("id", total(F.transform("vector", lambda x: F.round(x / F.col("scale")).cast("long"))).alias("int4")), "id")


@query(O.QUANTIZED_INT4_TOPK)
def quantized_int4_topk(spark, sf_dir):
    vectors, _ = _chunks(spark, sf_dir)
    return vector_index.rescored(vectors, _twentieths(spark, sf_dir), 8, "INT4", 16).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(O.QUANTIZED_FP16_TOPK)
def quantized_fp16_topk(spark, sf_dir):
    vectors, _ = _chunks(spark, sf_dir)
    return vector_index.rescored(vectors, _twentieths(spark, sf_dir), 8, "FP16").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(O.DENSE_ALL_CELLS)
def cells_all_topk(spark, sf_dir):
    """Search over k-means cells with every cell probed: the exact answer."""
    vectors, _ = _chunks(spark, sf_dir)
    model = vector_index.fit_cells(vectors, sample=20_000)
    hits = vector_index.probed(vector_index.celled(vectors, model), model, _twentieths(spark, sf_dir), 8, vector_index.LISTS)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query()
def cells_topk(spark, sf_dir):
    """Eight of ten cells probed; the recall against exact search is tested."""
    vectors, _ = _chunks(spark, sf_dir)
    model = vector_index.fit_cells(vectors, sample=20_000)
    hits = vector_index.probed(vector_index.celled(vectors, model), model, _twentieths(spark, sf_dir), 8)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


# More queries, which register themselves with ``query``
from lorespark.plans import chunk_queries, store_queries  # noqa: E402, F401
