"""Hybrid retrieval: dense and full-text candidates, rank fusion, floor, cap, bands.

``queries`` frames of a handful of rows (what one caller asks) are broadcast; larger ones are dealt into blocks, each of which meets
every block of the chunks (``operators.blocks``). ``chunks`` are never collected or broadcast: with few queries each is scored where it lies, and only the best
of each partition are shuffled.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException, IllegalArgumentException, SparkRuntimeException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import blocks, lexicon
from lorespark.sources import snapshots

log = logging.getLogger(__name__)

RRF_K = 60
FTS_ONLY_SCORE = 0.2
K1, B = 1.2, 0.75
#: Queries, or terms of queries, that are scored row by row in the JVM; more are scored by blocks (``operators.blocks``).
FEW = 64
#: Query rows that may be broadcast, and the queries, rows and shares of documents' scores of a block.
MAX_QUERIES = 10_000
ROW_BLOCK = 8_192
SHARE_BLOCK = 1_000_000
#: Hits and terms of a block of queries of more than MAX_QUERIES; shares are copied for each such block.
HIT_BLOCK, TERM_BLOCK = 2_000_000, 1_000_000


def _is_few(queries: DataFrame, most: int = MAX_QUERIES) -> bool:
    return queries.limit(most + 1).count() <= most


def _few(queries: DataFrame, most: int = MAX_QUERIES) -> DataFrame:
    """``queries`` for a join by query_id: broadcast where they are few."""
    return F.broadcast(queries) if _is_few(queries, most) else queries


def ranked(df: DataFrame, by: list, k: int, key: str = "query_id", name: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark cuts each partition to k before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*by)).cast("long")).where(F.col(name) <= k)


def nearest(rows: DataFrame, queries: DataFrame, on: list[str], k: int) -> DataFrame:
    """(query_id, id, score, rank): the k rows (id, v) of the best match score for each query (query_id, q) of the same columns ``on`` and length.

    A few queries are scored in the JVM where the rows lie; more are scored by blocks, from which only the best come out.
    """
    on = [*on, "_size"]
    v, q = rows.withColumn("_size", F.size("v")), queries.withColumn("_size", F.size("q"))
    if q.limit(FEW + 1).count() <= FEW:
        v, q = v.withColumn("_vn", T.norm("v")), q.withColumn("_qn", T.norm("q"))
        scored = v.join(F.broadcast(q), on).select("query_id", "id", T.match_score(1 - T.cosine("v", "q", "_vn", "_qn")).alias("score"))
    else:
        v, q = v.dropna(subset=on), q.dropna(subset=on)  # null keys meet nothing; groups would meet
        #: Blocks by the commonest key, so that none is larger than asked.
        most = lambda df: df.groupBy(*on).count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("n")).first()["n"]
        n, m = (max(1, -(-most(df) // size)) for df, size in ((v, ROW_BLOCK), (q, MAX_QUERIES)))
        scored = blocks.nearest(v, q, on, n, m, k)
    return ranked(scored, [F.desc(F.round("score", 9)), "id"], k)


def dense(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k chunks (id, vector) nearest by cosine to each query (query_id, vector).

    Scores are match scores, 1 - distance clamped to 0..1; vectors of another length than the query's are left out.
    """
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))
    return nearest(chunks.select("id", F.col("vector").cast("array<double>").alias("v")), q, [], k)


def postings(chunks: DataFrame) -> DataFrame:
    """(term, id, tf, dl): the inverted index of chunks (id, text), to be stored by term."""
    tokens = chunks.select("id", T.search_tokens("text").alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    return tokens.select("id", "dl", F.explode("tokens").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf")).select("term", "id", "tf", "dl")


def bm25(chunks: DataFrame, queries: DataFrame, k: int, words: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k chunks (id, text) of the best BM25 score for each query (query_id, text); any term may match.

    With ``words`` (``lexicon.learnt``) wide characters are cut into words, otherwise into overlapping pairs. Only the queries' terms are kept of a text, or all where the queries are many. Texts are read when this is called.
    """
    cut = (lambda rows: rows.withColumn("tokens", T.search_tokens("text"))) if words is None else (lambda rows: lexicon.tokens(rows, words))
    terms = cut(queries.select("query_id", "text")).select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
    few = terms.limit(FEW + 1).count() <= FEW
    terms = terms if few else snapshots.kept(terms, "terms")
    tokens = cut(chunks.select("id", F.coalesce("text", F.lit("")).alias("text")))
    if few:
        wanted = [r["term"] for r in terms.select("term").distinct().collect()]
        hits = F.filter("tokens", lambda t: t.isin(wanted)) if wanted else F.array().cast("array<string>")
    else:
        hits = F.col("tokens")
    #: Written once, so that the texts are read and cut into words in one pass, whatever is counted of them.
    found = snapshots.kept(tokens.select("id", F.size("tokens").alias("dl"), hits.alias("hits")), "fts")
    corpus = found.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    #: Rows are dealt by id before their words are counted, so that words are never shuffled. Words that no query has go first.
    asked = terms.select("term").distinct()
    words = found.repartition("id").select("id", "dl", F.explode("hits").alias("term"))
    words = words if few else words.join(_few(asked), "term", "left_semi")
    tf = words.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    tf = tf if few else snapshots.kept(tf, "tf")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    #: A row for each of the queries' terms at most.
    df = df.crossJoin(F.broadcast(corpus)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    shares = tf.crossJoin(F.broadcast(corpus)).select("term", "id", share.alias("share"))
    return best_sums(shares, terms.join(df, "term"), k, few)


def best_sums(shares: DataFrame, terms: DataFrame, k: int, few: bool, size: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k documents with the largest sum of shares (term, id, share) for each query, by its terms (query_id, term, weight).

    A few terms meet the shares where these lie; more are summed up by blocks, from which only the best come out. ``size``: how many documents and shares there are, if known.
    """
    if few:
        total = shares.join(F.broadcast(terms), "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("share")).alias("score"))
    else:
        ids, rows = size or shares.agg(F.approx_count_distinct("id"), F.count("*")).first()
        asked, held = terms.agg(F.count_distinct("query_id"), F.count("*")).first()
        n = max(1, -(-ids // ROW_BLOCK), -(-rows // SHARE_BLOCK))
        #: Shares are far more than terms: blocks of queries are as large as their hits and terms allow.
        m = min(-(-asked // MAX_QUERIES), max(-(-asked * k // HIT_BLOCK), -(-held // TERM_BLOCK)))
        total = blocks.best_sums(shares, terms, n, max(1, m), k)
    total = total.select("query_id", "id", F.round("score", 9).alias("score"))
    return ranked(total, [F.desc("score"), "id"], k)


def or_none(search, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a text search gives, or no hits where its index is missing or can't be read: a search goes on by vectors alone, and its mode says so."""
    try:
        return search()
    except (AnalysisException, SparkRuntimeException, IllegalArgumentException) as e:
        log.warning("text search failed, going on by vectors alone: %s", str(e).split("\n")[0])
        none = chunks.sparkSession.createDataFrame([], "score double, rank long")
        return queries.select("query_id").limit(0).crossJoin(chunks.select("id").limit(0)).crossJoin(none)


def text_hits(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``bm25`` over the chunks themselves, or no hits where it can't be made."""
    return or_none(lambda: bm25(chunks, queries, k), queries, chunks)


def fuse(dense_hits: DataFrame, fts_hits: DataFrame) -> DataFrame:
    """(query_id, id, rrf, dense_rank, fts_rank, score): both lists merged by reciprocal rank.

    Fusion decides the order only; the score is the hit's own dense one, or FTS_ONLY_SCORE where it has none.
    """
    null = F.lit(None)
    d = dense_hits.select("query_id", "id", F.col("rank").alias("dense_rank"), null.cast("long").alias("fts_rank"), F.col("score").alias("dense"))
    f = fts_hits.select("query_id", "id", null.cast("long").alias("dense_rank"), F.col("rank").alias("fts_rank"), null.cast("double").alias("dense"))
    both = d.unionByName(f).groupBy("query_id", "id").agg(F.max("dense_rank").alias("dense_rank"), F.max("fts_rank").alias("fts_rank"), F.max("dense").alias("dense"))
    one = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    return both.select("query_id", "id", (one("dense_rank") + one("fts_rank")).alias("rrf"), "dense_rank", "fts_rank", F.coalesce("dense", F.lit(FTS_ONLY_SCORE)).alias("score"))


def floored(hits: DataFrame, min_score: float) -> DataFrame:
    return hits.where(F.col("score") >= min_score)


def _capped(fused: DataFrame, topk: int, min_score: float) -> DataFrame:
    order = [F.desc(F.round("rrf", 12)), F.coalesce("dense_rank", F.lit(2**31)), "id"]
    return ranked(floored(fused, min_score), order, topk).select("query_id", "id", "rank", "score", T.confidence_band("score").alias("band"), "dense_rank", "fts_rank")


def _stats(fused: DataFrame, min_score: float) -> DataFrame:
    stats = fused.groupBy("query_id").agg(
        F.count_if(F.col("score") < min_score).alias("below_floor"),
        F.count_if(F.col("dense_rank").isNull() & (F.col("score") >= min_score)).alias("fts_only_hits"),
        F.count_if(F.col("fts_rank").isNotNull()).alias("_fts"),
    )
    return stats.select("query_id", F.when(F.col("_fts") > 0, "hybrid").otherwise("dense").alias("mode"), "below_floor", "fts_only_hits")


def searched(dense_hits: DataFrame, fts_hits: DataFrame, topk: int = 8, min_score: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """Hits (as ``hybrid`` gives them) and statistics (as ``search_stats``) of one run: the candidates are found once and written, then both are read from them."""
    fused = snapshots.kept(fuse(dense_hits, fts_hits), "fused")
    return _capped(fused, topk, min_score), _stats(fused, min_score)


def hybrid(chunks: DataFrame, queries: DataFrame, topk: int = 8, min_score: float = 0.55, candidates: int = 100) -> DataFrame:
    """(query_id, id, rank, score, band, dense_rank, fts_rank): floor before cap, in the order of the fusion."""
    pool = max(candidates, topk)
    return _capped(fuse(dense(chunks, queries, pool), text_hits(chunks, queries, pool)), topk, min_score)


def search_stats(chunks: DataFrame, queries: DataFrame, min_score: float = 0.55, candidates: int = 100) -> DataFrame:
    """(query_id, mode, below_floor, fts_only_hits) of each query that has candidates; without words to look for, the mode is dense."""
    return _stats(fuse(dense(chunks, queries, candidates), text_hits(chunks, queries, candidates)), min_score)


def with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their document's name; a missing document keeps the hit under its id."""
    named = documents.select(F.col("doc_id").alias("id"), F.col("name").alias("_name"))
    return hits.join(named, "id", "left").withColumn("name", F.coalesce("_name", F.col("id").cast("string"))).drop("_name")
