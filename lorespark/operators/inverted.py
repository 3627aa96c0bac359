"""A stored inverted index: posting lists by term in a ``Store``, kept up with each change, searched by block-max pruning.

The documents of one update are dealt into spans of about SPAN by a hash of their ids, and a posting list has one block for each span that holds the
term: its entries (id, owner, occurrences, length), and the largest share of a BM25 score that one of them can have. Blocks of different terms thus cover the same documents, so the sum
of their bounds is the most that a document of the span can score. A search reads the bounds alone, scores the spans of the largest bounds, and
then only those further spans whose bound reaches the k-th score found; what it skips can't be among the first k.

Three tables: postings and counts (documents and words by term; the empty term stands for the corpus) are dealt by a hash of the term, so that a search opens the files of its terms' buckets;
marks say that an owner's postings of earlier updates are dead. All three are additive: an update writes its own rows, with negative counts for what goes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lorespark.functions.batches import bounded
from lorespark.functions import text as T
from lorespark.operators import retrieval
from lorespark.operators.retrieval import B, K1, MAX_QUERIES, ranked
from lorespark.sources import snapshots
from lorespark.sources.store import Store, Transaction

SPAN = 128
#: Spans of the largest bounds that a query scores first.
FIRST = 16
#: Words of a partition that blocks are made in, at most and, where they are few, at least.
MOST_WORDS, LEAST_WORDS = 4_000_000, 250_000
#: Documents scored before the others' bounds are compared, as a multiple of k.
AHEAD = 2
#: Distinct terms of queries, and marks, that may be broadcast, so that postings meet them without a shuffle.
MAX_TERMS, MAX_MARKS = 500_000, 2_000_000
POSTINGS, COUNTS, MARKS = "text_postings", "text_counts", "text_marks"
_COUNTS = "term string, df long, words long"


def impact(tf, dl, avgdl):
    """The share of a BM25 score that a term's occurrences give, before the term's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def weight(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _tokens():
    return T.search_tokens(F.coalesce("text", F.lit("")))


def tokenized(rows: DataFrame) -> DataFrame:
    """(id, owner, tokens, dl) of documents (id, owner, text), written once: texts are cut into words in one pass."""
    tokens = rows.select("id", "owner", _tokens().alias("tokens"))
    return snapshots.kept(tokens.withColumn("dl", F.size("tokens").cast("long")), "tokens")


def counts(tokens: DataFrame, sign: int = 1) -> DataFrame:
    """(term, df, words) of tokenized documents; the empty term's row has the documents and words of all."""
    terms = tokens.select("dl", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg((sign * F.count("*")).alias("df"), F.lit(0).cast("long").alias("words"))
    every = tokens.agg((sign * F.count("*")).alias("df"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("words"))
    return terms.unionByName(every.select(F.lit("").alias("term"), "df", "words"))


def _kind(rows: DataFrame) -> str:
    """The schema of the posting blocks of documents (id, owner)."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "owner")}
    return f"term string, span int, n long, peak double, entries array<struct<id:{kinds['id']},owner:{kinds['owner']},tf:bigint,dl:bigint>>"


def blocks(rows: DataFrame, update: int, total: tuple[int, int], span: int = SPAN) -> DataFrame:
    """(term, update, span, n, peak, avgdl, entries): posting blocks of documents (id, owner, text); ``total``: how many documents and words there are.

    What is shuffled is texts, once, by span; words are cut and counted where a span's documents have met.
    """
    n, words = total
    spans, avgdl = max(1, -(-n // span)), max(1.0, words / n if n else 0.0)
    few = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // LEAST_WORDS))
    dealt = rows.select("id", "owner", "text", F.pmod(F.xxhash64("id"), F.lit(spans)).cast("int").alias("span")).repartition(max(1, -(-words // MOST_WORDS), few), "span")
    kind = _kind(dealt)

    def run(key, docs):
        import pyarrow as pa
        import pyarrow.compute as pc

        tokens = docs.column("tokens").combine_chunks()
        dl = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        #: Rows that repeat an id, owner and length count together, in order of the id.
        place = {d: None for d in zip(docs.column("id").to_pylist(), docs.column("owner").to_pylist(), dl.tolist())}
        order = sorted(place, key=lambda d: [(x is not None, x) for x in d])
        place = {d: i for i, d in enumerate(order)}
        own = np.array([place[d] for d in zip(docs.column("id").to_pylist(), docs.column("owner").to_pylist(), dl.tolist())], np.int64)
        known = tokens.flatten().dictionary_encode()
        pair, tf = np.unique(known.indices.to_numpy().astype(np.int64) * len(order) + np.repeat(own, dl), return_counts=True)
        term, doc = np.divmod(pair, len(order))
        length = np.array([d[2] for d in order], np.int64)[doc]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        share = impact(tf, length, avgdl)
        ids = [pa.array([d[i] for d in order], docs.schema.field(c).type).take(pa.array(doc)) for i, c in enumerate(("id", "owner"))]
        entries = pa.StructArray.from_arrays([*ids, pa.array(tf.astype(np.int64)), pa.array(length)], ["id", "owner", "tf", "dl"])
        ends = np.r_[first, len(term)]
        peak = np.maximum.reduceat(share, first) if len(first) else np.empty(0)
        return pa.table({
            "term": known.dictionary.take(pa.array(term[first])), "span": pa.array(np.full(len(first), key[0].as_py(), np.int32)), "n": pa.array(np.diff(ends)),
            "peak": pa.array(peak), "entries": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
        })

    cut = dealt.select("id", "owner", "span", _tokens().alias("tokens"))
    made = cut.transform(bounded).groupBy("span").applyInArrow(run, kind)
    return made.select("term", F.lit(update).cast("long").alias("update"), "span", "n", "peak", F.lit(avgdl).alias("avgdl"), "entries")


def _summed(t: Transaction, total: tuple[int, int], number: int) -> DataFrame:
    """What ``counts`` gives for the documents whose blocks update ``number`` wrote, from the blocks' sizes."""
    every = t.store.spark.createDataFrame([("", *total)], _COUNTS)
    return t.written(POSTINGS).where(F.col("update") == number).groupBy("term").agg(F.sum("n").alias("df"), F.lit(0).cast("long").alias("words")).unionByName(every)


def update(t: Transaction, fresh: DataFrame, number: int, removed: DataFrame | None = None, owners: DataFrame | None = None) -> None:
    """Adds documents (id, owner, text) to the index as update ``number``, in place of all of their ``owners``; ``removed`` are the documents that go.

    Numbers grow from update to update. Without ``removed`` the index is made anew. ``fresh`` is read twice: its words are counted before its blocks are made.
    """
    total = tuple(fresh.agg(F.count("*"), F.coalesce(F.sum(F.size(_tokens())), F.lit(0)).cast("long")).first())
    made = blocks(fresh, number, total)
    if removed is None or POSTINGS not in t.base["tables"]:
        t.replace(POSTINGS, made, "term", additive=True, dealt="sorted")
        t.replace(COUNTS, _summed(t, total, number), "term", additive=True)
        t.replace(MARKS, t.store.spark.createDataFrame([], "owner string, update long"), "owner", additive=True)
        return
    t.append(POSTINGS, made, "term", additive=True, dealt="sorted")
    t.append(COUNTS, _summed(t, total, number), "term", additive=True)
    forget(t, removed, number, owners)


def forget(t: Transaction, removed: DataFrame, number: int, owners: DataFrame | None = None) -> None:
    """Takes documents (id, owner, text) out: postings of their owners that are older than update ``number`` are dead."""
    t.append(COUNTS, counts(tokenized(removed), -1), "term", additive=True)
    owners = (removed if owners is None else owners).select(F.col("owner").cast("string").alias("owner")).distinct()
    t.append(MARKS, owners.withColumn("update", F.lit(number).cast("long")), "owner", additive=True)


def documents(store: Store, record: dict | None = None) -> int:
    """How many documents the index holds."""
    known = store.read(COUNTS, record, keys=[""])
    return 0 if known is None else known.agg(F.sum("df").alias("n")).first()["n"] or 0


def _marks(store: Store, record: dict) -> DataFrame | None:
    """(_owner, _last): the update before which an owner's postings are dead; broadcast up to MAX_MARKS, None where nothing is marked."""
    marked = sum(part["rows"] for part in record["tables"][MARKS]["segments"])
    if not marked:
        return None
    dead = store.read(MARKS, record).groupBy(F.col("owner").alias("_owner")).agg(F.max("update").alias("_last"))
    return F.broadcast(dead) if marked <= MAX_MARKS else dead


def _live(found: DataFrame, marks: DataFrame | None, avgdl: float, owners: list | None = None) -> DataFrame:
    """Posting blocks as a row (id, owner, share of a score) for each entry that isn't dead; beside it the columns of ``found`` but the blocks' own."""
    rows = found.select(*[c for c in found.columns if c != "entries"], F.explode("entries").alias("e"))
    rows = rows.select("*", "e.id", "e.owner", impact(F.col("e.tf"), F.col("e.dl"), F.lit(avgdl)).alias("share")).drop("e")
    if owners is not None:
        rows = rows.where(F.col("owner").isin(owners))
    if marks is not None:
        rows = rows.join(marks, (F.col("owner").cast("string") == F.col("_owner")) & (F.col("update") < F.col("_last")), "left_anti")
    return rows


def _scores(found: DataFrame, marks: DataFrame | None, avgdl: float, owners: list | None = None) -> DataFrame:
    """(query_id, id, score) from posting blocks that have the weight of the query's term."""
    rows = _live(found.select("query_id", "update", "weight", "entries"), marks, avgdl, owners)
    return rows.groupBy("query_id", "id").agg(F.round(F.sum(F.col("weight") * F.col("share")), 9).alias("score"))


def search(store: Store, queries: DataFrame, k: int, record: dict | None = None, first: int = FIRST, owners: list | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k documents of the best BM25 score for each query (query_id, text), by the index in a version of the store; of some ``owners`` only, if given.

    Blocks are left out by their bounds where the queries have some terms (``retrieval.FEW``); queries of more terms are scored together by blocks of documents.
    """
    spark, record = store.spark, record or store.record()
    terms = queries.select("query_id", F.explode(F.array_distinct(T.search_tokens("text"))).alias("term"))
    #: Few terms are looked up at once, so that all that follows joins a table of some thousand rows at most.
    pairs = terms.limit(MAX_QUERIES + 1).collect()
    few = len(pairs) <= MAX_QUERIES
    wanted = sorted({r["term"] for r in pairs}) if few else None
    known = lambda keys: store.read(COUNTS, record, keys=keys)
    summed = lambda some: some.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    read = {r["term"]: r for r in summed(known([*(wanted or []), ""])).collect()}
    n, words = (read[""]["df"], read[""]["words"]) if "" in read else (0, 0)
    if not n or not pairs:
        return ranked(spark.createDataFrame([], "score double").crossJoin(queries.select("query_id").limit(0)).crossJoin(_ids(store, record)).select("query_id", "id", "score"), ["id"], k)
    avgdl = max(words / n, 1e-9)
    if few:
        rows = [(r["query_id"], r["term"], read[r["term"]]["df"]) for r in pairs if r["term"] in read and read[r["term"]]["df"] > 0]
        weights = F.broadcast(spark.createDataFrame(rows, StructType([*terms.schema.fields, StructField("df", LongType())])).select("query_id", "term", weight(F.lit(n), F.col("df")).alias("weight")))
    else:
        #: Written once: what follows reads them several times, and counts of other terms aren't summed up.
        terms = snapshots.kept(terms, "terms")
        held = summed(known(None).join(retrieval._few(terms.select("term").distinct(), MAX_TERMS), "term", "left_semi")).where("df > 0")
        weights = snapshots.kept(terms.join(held, "term").select("query_id", "term", weight(F.lit(n), F.col("df")).alias("weight")), "weights")
    postings = store.read(POSTINGS, record, keys=wanted)
    marks = _marks(store, record)
    if len(pairs) > retrieval.FEW:
        #: Many queries together need most blocks of their terms: each is read once for all of them.
        postings = postings.join(retrieval._few(weights.select("term").distinct(), MAX_TERMS), "term", "left_semi")
        shares = _live(postings.select("term", "update", "entries"), marks, avgdl, owners)
        held = postings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        return retrieval.best_sums(shares.select("term", "id", "share"), weights, k, False, (n, held))
    #: The peak was taken at another mean length; it grows by the lengths' ratio at most.
    bound = F.col("weight") * F.col("peak") * F.greatest(F.lit(1.0), F.lit(avgdl) / F.col("avgdl"))
    spans = postings.select("term", "update", "span", "peak", "avgdl").join(weights, "term").groupBy("query_id", "update", "span").agg(F.sum(bound).alias("bound"))
    spans = snapshots.kept(spans, "bounds")
    chosen = ranked(spans, [F.desc("bound"), "update", "span"], max(first, -(-AHEAD * k // SPAN))).select("query_id", "update", "span")
    blocks_of = lambda some: _scores(postings.join(weights, "term").join(some, ["query_id", "update", "span"], "left_semi"), marks, avgdl, owners)
    ahead = snapshots.kept(blocks_of(chosen), "ahead")
    least = ranked(ahead, [F.desc("score"), "id"], k).groupBy("query_id").agg(F.max("rank").alias("_n"), F.min("score").alias("_least")).where(F.col("_n") >= k).select("query_id", "_least")
    rest = spans.join(least, "query_id", "left").where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - 1e-6)).select("query_id", "update", "span")
    rest = rest.join(chosen, ["query_id", "update", "span"], "left_anti")
    return ranked(ahead.unionByName(blocks_of(rest)), [F.desc("score"), "id"], k)


def _ids(store: Store, record: dict) -> DataFrame:
    """An empty frame of the ids' type."""
    found = store.read(POSTINGS, record)
    return found.select(F.explode("entries").alias("e")).select("e.id").limit(0)
