"""URL filters: rules first, then a model over segmented names.

Host names are cut at dots, hyphens and digits, and each run of letters is split into words by a unigram Viterbi
search; so are the words of the path. Word frequencies come from the visible text of all pages. A multinomial naive Bayes
model over these words scores urls that no rule fits.

There are no labelled urls, so a url is taken as unwanted for training where its words hold one of SEEDS. The word that gave the label is left out of
that url's counts (with two seeds or more each is labelled by another), so that the model learns what stands beside the seeds, not the list: a seed
by itself weighs nothing, and words that keep unwanted company weigh without any seed. Counts are smoothed by each word's
share of all counts, so that rare words weigh little either way.

Neither the words that the search knows nor those that the model weighs are limited: substrings of the distinct names meet the
words by a join (words of more than LONGEST letters by their first LONGEST), and so do the pages' words their weights. What is most
frequent (HOT keys) is looked up by broadcast instead. Rules are a list kept by the caller and are broadcast too: some thousands,
not a table that grows with the data.

A url that is null or has no ``://`` has an empty host and path, no words, and is allowed. Repeated urls and pages are judged each, also those
without a page_id. With no pages there are no rows. Other columns are left out.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_column, stored, with_nulls

#: (verdict, host, path): the rules of the query (fixed values).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Words that mark a url as unwanted in training.
SEEDS = frozenset("casino bets betting poker pills viagra porn xxx loans ads track".split())
#: Letters of the substrings that are looked up whole.
LONGEST = 24
#: Counts that smoothing adds to a class for each distinct word.
SMOOTHING = 0.25
#: Keys whose facts are broadcast in a join, the most frequent ones, so that no task gets all rows of one; it decides no result.
HOT = 10_000


def parsed(url):
    """Columns host and path of a url column."""
    whole = F.coalesce(url, F.lit(""))
    get = lambda i: F.regexp_extract(whole, r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(get(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), get(2).alias("path")


class RuleBook:
    """Finds the longest rule for a url: hosts are looked up by suffix, so the number of rules doesn't matter."""

    def __init__(self, rules):
        self.by_host: dict[str, list] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((len(host + path), path, host + path, verdict))
        for found in self.by_host.values():
            found.sort(reverse=True)

    def find(self, host: str, path: str):
        best, at = None, 0
        while host:
            for rule in self.by_host.get(host[at:], ()):
                if path.startswith(rule[1]):
                    best = max(best, rule) if best else rule
                    break
            at = host.find(".", at) + 1
            if not at:
                break
        return (best[2], best[3]) if best else (None, None)


class Segmenter:
    """Splits runs of letters into the likeliest words of a unigram model.

    ``counts`` need hold only the words that are substrings of the names to be split; ``total`` counts all words. A word that isn't
    known may have any length and costs more with each letter. Of equally likely splits the one whose last word is longest is taken.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) or 1
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.unknown, self.letter = math.log(total), 2.3
        self.lengths = sorted({len(w) for w in counts}, reverse=True)

    def split(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        open_, start = math.inf, 0  # the least cost of an unknown word that ends here, and where it starts
        for j in range(1, len(name) + 1):
            fresh = best[j - 1] + self.unknown
            open_, start = (open_ + self.letter, start) if open_ <= fresh else (fresh + self.letter, j - 1)
            least, at = open_, start
            for n in self.lengths:
                if n <= j and (cost := self.cost.get(name[j - n : j])) is not None:
                    whole = best[j - n] + cost
                    if whole < least or (whole == least and j - n < at):
                        least, at = whole, j - n
            best.append(least)
            back.append(at)
        words, j = [], len(name)
        while j:
            words.append(name[back[j] : j])
            j = back[j]
        return words[::-1]


def names_of(host: str, path: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", f"{host} {path.lower()}")


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, count) of all words of the pages' visible text."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*+>", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 2)
    return words.groupBy("word").count()


def _looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` (key, n, ...), which has one row for each key of ``rows``; n rows hold the key."""
    hot = stored(facts.orderBy(F.desc("n"), key).limit(HOT), "url-hot")
    keys = F.broadcast(hot.select(key))
    rest = rows.join(keys, key, "left_anti").join(facts.join(keys, key, "left_anti"), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, n, words) of ``names`` (id, name, n) by all words of ``counts``, with the seeds at least as frequent as the rarest word."""
    found = {r["word"]: r["count"] for r in counts.where(F.col("word").isin(*SEEDS)).collect()}
    all_words = counts.agg(F.sum("count").alias("total"), F.min("count").alias("least")).first()
    seeds = {w: max(all_words["least"] or 1, found.get(w, 0)) for w in SEEDS}
    total = (all_words["total"] or 0) - sum(found.values()) + sum(seeds.values())

    runs = names.select("id", F.explode(F.array_distinct(F.split("name", r"[^\p{L}]+"))).alias("run")).where(F.length("run") >= 2)
    starts = runs.select("id", "run", F.explode(F.sequence(F.lit(1), F.length("run") - 1)).alias("i"))
    ends = starts.select("id", "run", "i", F.explode(F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("run") - F.col("i") + 1))).alias("k"))
    parts = ends.select("id", F.expr("substring(run, i, k)").alias("word"))
    facts = stored(parts.groupBy("word").agg(F.count("*").alias("n")).join(counts, "word", "left"), "url-parts")
    known = _looked_up(parts, facts, "word").where(F.col("count").isNotNull()).select("id", "word", "count")
    long = counts.where(F.length("word") > LONGEST).select(F.left("word", F.lit(LONGEST)).alias("head"), F.col("word").alias("whole"), "count")
    heads = starts.where(F.length("run") - F.col("i") >= LONGEST).withColumn("head", F.expr(f"substring(run, i, {LONGEST})"))
    longer = heads.join(long, "head").where("substring(run, i, length(whole)) = whole").select("id", F.col("whole").alias("word"), "count")
    own = known.unionByName(longer).groupBy("id").agg(F.collect_set(F.struct("word", "count")).alias("own"))

    def cut(batches):
        for pdf in batches:
            words = [Segmenter({r["word"]: r["count"] for r in (() if o is None else o)} | seeds, total).split(name) for name, o in zip(pdf["name"], pdf["own"])]
            yield pdf[["name", "n"]].assign(words=words)

    return names.join(own, "id", "left").select("name", "n", "own").mapInPandas(cut, "name string, n long, words array<string>")


def _in_order(column: str):
    """All values of a column of a group, by their place."""
    return F.transform(F.array_sort(F.collect_list(F.struct("at", column))), lambda x: x[column])


def weighed(rows: DataFrame) -> tuple[DataFrame, float]:
    """((token, n, weight), prior) of the naive Bayes model of ``rows`` (tokens); weights are logarithms of odds for ``block``."""
    seeds = F.array(*[F.lit(w) for w in sorted(SEEDS)])
    rows = rows.withColumn("held", F.array_intersect("tokens", seeds)).withColumn("bad", F.size("held") > 0)
    docs = {r["bad"]: r["n"] for r in rows.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    each = rows.select("bad", F.when(F.size("held") == 1, F.col("held")[0]).alias("label"), F.explode("tokens").alias("token"))
    counts = F.coalesce(F.col("token") != F.col("label"), F.lit(True))
    per = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("bad") & counts).alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    per = stored(per, "url-weights")
    sums = per.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("kinds")).first()
    bad, good, kinds = ((sums[c] or 0) for c in ("bad", "good", "kinds"))
    counted, added = F.col("bad") + F.col("good"), SMOOTHING * kinds
    share = counted * (added / max(1, bad + good))
    weight = F.log((F.col("bad") + share) / (bad + added)) - F.log((F.col("good") + share) / (good + added))
    return per.select("token", "n", F.when(counted > 0, weight).otherwise(0.0).alias("weight")), math.log((docs.get(True, 0) + 1) / (docs.get(False, 0) + 1))


def scored(rows: DataFrame, facts: DataFrame, prior: float) -> DataFrame:
    """(row, odds) of each of ``rows`` (row, tokens) that has tokens, with facts about each of them."""
    tokens = rows.select("row", F.posexplode("tokens").alias("at", "token"))
    #: Summed in the order of the url, so that a sum doesn't depend on how rows are dealt.
    return _looked_up(tokens, facts, "token").groupBy("row").agg(F.aggregate(_in_order("weight"), F.lit(prior), lambda a, x: a + x).alias("odds"))


def tokenized(pages: DataFrame, rules) -> DataFrame:
    """(row, page_id, host, path, rule, ruled, tokens) of every row of ``pages`` (page_id, url, html)."""
    own = pages.sparkSession.sparkContext.broadcast(list(rules))

    def read(batches):
        book = RuleBook(own.value)
        for pdf in batches:
            ruled = [book.find(h, p) for h, p in zip(pdf["host"], pdf["path"])]
            yield pdf.assign(rule=[r for r, _ in ruled], ruled=[v for _, v in ruled], names=[names_of(h, p) for h, p in zip(pdf["host"], pdf["path"])])

    rows = pages.select(id_column("page_id"), *parsed(F.col("url")))
    rows = rows.mapInPandas(read, "page_id long, host string, path string, rule string, ruled string, names array<string>")
    rows = stored(with_nulls(rows, "page_id").withColumn("row", F.monotonically_increasing_id()), "url-names")

    held = rows.select("row", F.posexplode("names").alias("at", "name"))
    names = stored(held.groupBy("name").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "url-distinct")
    counts = stored(word_counts(pages), "url-words")
    segments = stored(segmented(names, counts), "url-segments")
    tokens = _looked_up(held, segments, "name").groupBy("row").agg(F.flatten(_in_order("words")).alias("tokens"))
    out = stored(rows.drop("names").join(tokens, "row", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), "url-tokens")
    for done in (rows, names, counts, segments):
        discard(done)
    return out


def judge_urls(pages: DataFrame, rules) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html)."""
    rows = tokenized(pages, rules)
    odds = scored(rows.where(F.col("ruled").isNull()), *weighed(rows))
    model = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return rows.join(odds, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", model).alias("verdict"))
