"""Words of text that is written without spaces: learnt from the corpus, cut by the likeliest path.

A string of characters counts as a word where its parts stay together more often than chance has them meet (cohesion) and where what stands before and after
it varies (freedom: the lesser of both sides' entropies). Counts are taken over every run of the corpus, as groupings of short strings. A run is then cut
over the lattice of the words found in it. Strings that no word covers may be one unknown word of any length, dearer with each character, so that a name that is
rare everywhere stays whole instead of falling into characters that each match half of the corpus.

The words aren't broadcast: substrings of the distinct runs meet them by a join, so a lexicon may be as large as the corpus makes it.
A null or empty text has no runs and no words.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.batches import bounded
from lorespark.functions.text import WIDE
from lorespark.sources import snapshots

#: The longest word that is learnt.
LONGEST = 4
#: A word occurs so often, its parts meet exp(COHESION) times as often as by chance, and its neighbours' entropy is FREEDOM nats.
LEAST, COHESION, FREEDOM = 5, 3.0, 1.0
#: What an unknown word costs more with each of its characters, in nats: a character commoner than one in a hundred stands for itself rather than in such a word.
LETTER = 4.6
#: Letters and digits among wide characters; their punctuation ends a run.
_LETTER = f"[{WIDE}&&[\\p{{L}}\\p{{N}}]]"
_EDGE = "\n"


def wide_runs(texts: DataFrame) -> DataFrame:
    """(run): stretches of wide characters of texts (text)."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"{_LETTER}+"), 0)).alias("run"))


def grams(runs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(gram, n, cohesion, freedom) of all strings of up to ``longest`` characters of runs (run).

    The edge of a run is a neighbour like no other. Cohesion is the least over the places where a string can be cut: the logarithm of how much
    more often both parts meet than by chance; null for one character.
    """
    #: A window is a start with its neighbour before and all that a string from there may need; one scan of a run finds all, each from the character behind the last one's start.
    edged = F.concat(F.lit(_EDGE), "run", F.lit(_EDGE * longest))
    windows = runs.where("run <> ''").select(F.explode(F.regexp_extract_all(edged, F.lit(f"(?s)(?=(.{{{longest + 2}}}))."), 1)).alias("w"))
    each = windows.groupBy("w").agg(F.count("*").alias("c"))
    strings = each.select("c", F.left("w", F.lit(1)).alias("before"), F.explode(F.array(*[F.substring("w", 2, k + 1) for k in range(1, longest + 1)])).alias("s"))
    strings = strings.withColumns({"gram": F.expr("left(s, length(s) - 1)"), "after": F.right("s", F.lit(1))}).where(~F.col("gram").contains(_EDGE))
    counted = snapshots.kept(strings.groupBy("gram", "before", "after").agg(F.sum("c").alias("c")), "grams")

    def side(name: str) -> DataFrame:
        ways = counted.groupBy("gram", name).agg(F.sum("c").alias("c"))
        weighed = F.when(F.col(name) != _EDGE, F.col("c") * F.log(F.col("c").cast("double"))).otherwise(0.0)
        return ways.groupBy("gram").agg(F.sum("c").alias(f"n_{name}"), (F.log(F.sum("c").cast("double")) - F.sum(weighed) / F.sum("c")).alias(f"h_{name}"))

    both = snapshots.kept(side("before").join(side("after"), "gram").select("gram", F.col("n_before").alias("n"), F.least("h_before", "h_after").alias("freedom")), "freedom")
    total = both.where("length(gram) = 1").agg(F.sum("n").alias("total"))
    cuts = both.where("length(gram) > 1").select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("at"))
    cuts = cuts.select("gram", "n", F.expr("left(gram, at)").alias("head"), F.expr("substring(gram, at + 1)").alias("tail"))
    part = lambda name: both.select(F.col("gram").alias(name), F.col("n").alias(f"n_{name}"))
    met = cuts.join(part("head"), "head").join(part("tail"), "tail").crossJoin(F.broadcast(total))  # one row
    met = met.groupBy("gram").agg(F.min(F.log(F.col("n") * F.col("total") / (F.col("n_head").cast("double") * F.col("n_tail")))).alias("cohesion"))
    return both.join(met, "gram", "left").select("gram", "n", "cohesion", "freedom")


def learnt(texts: DataFrame, least: int = LEAST, cohesion: float = COHESION, freedom: float = FREEDOM, longest: int = LONGEST) -> DataFrame:
    """(word, n) of the words of texts (text): strings that pass all three bounds, and every single character."""
    found = grams(wide_runs(texts), longest)
    whole = (F.col("n") >= least) & (F.col("cohesion") >= cohesion) & (F.col("freedom") >= freedom)
    return found.where((F.length("gram") == 1) | whole).select(F.col("gram").alias("word"), "n")


def cut(run: str, known: dict[str, int], total: int) -> list[str]:
    """The likeliest words of a run; of equally likely cuts the one whose last word is longest."""
    base = math.log(max(total, 2))
    best, back = [0.0], [0]
    open_, start = math.inf, 0  # the least cost of an unknown word that ends here, and where it starts
    longest = max(map(len, known), default=1)
    for j in range(1, len(run) + 1):
        fresh = best[j - 1] + base
        open_, start = (open_ + LETTER, start) if open_ <= fresh else (fresh + LETTER, j - 1)
        least, at = open_, start
        for i in range(max(0, j - longest), j):
            n = known.get(run[i:j])
            if n and ((cost := best[i] + base - math.log(n)) < least or (cost == least and i < at)):
                least, at = cost, i
        best.append(least)
        back.append(at)
    words, j = [], len(run)
    while j:
        words.append(run[back[j] : j])
        j = back[j]
    return words[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words) of the distinct runs of ``runs`` (run) by a lexicon (word, n)."""
    runs = snapshots.kept(runs.select("run").distinct(), "runs")
    facts = words.agg(F.coalesce(F.sum(F.when(F.length("word") == 1, F.col("n"))), F.lit(0)).alias("total"), F.coalesce(F.max(F.length("word")), F.lit(1)).alias("longest")).first()
    total, longest = facts["total"], facts["longest"]
    characters = runs.select("run", F.regexp_extract_all("run", F.lit("(?s)."), 0).alias("c"))
    windows = characters.select("run", F.explode(F.transform(F.sequence(F.lit(1), F.size("c")), lambda i: F.array_join(F.slice("c", i, F.lit(longest)), ""))).alias("w"))
    parts = windows.select("run", F.explode(F.array_distinct(F.array(*[F.expr(f"left(w, {k})") for k in range(1, longest + 1)]))).alias("word")).distinct()
    own = parts.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("own"))

    def run_cut(batches):
        for pdf in batches:
            yield pd.DataFrame({"run": pdf["run"], "words": [cut(r, {w["word"]: w["n"] for w in (() if o is None else o)}, total) for r, o in zip(pdf["run"], pdf["own"])]})

    return runs.join(own, "run", "left").select("run", "own").transform(bounded).mapInPandas(run_cut, "run string, words array<string>")


def tokens(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` (text) with the column ``tokens``: lower-cased words, those of wide characters by a lexicon (word, n)."""
    rows = snapshots.kept(rows.withColumn("_row", F.monotonically_increasing_id()), "lexed")
    some = f"{_LETTER}+|(?:(?![{WIDE}])[\\p{{L}}\\p{{N}}])+"
    parts = rows.select("_row", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(some), 0)).alias("at", "run"))
    wide = F.col("run").rlike(f"[{WIDE}]")
    plain = parts.where(~wide).select("_row", "at", F.array("run").alias("words"))
    spoken = parts.where(wide).join(segmented(parts.where(wide), words), "run").select("_row", "at", "words")
    whole = plain.unionByName(spoken).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("in_order"))
    ordered = whole.select("_row", F.flatten(F.transform("in_order", lambda x: x["words"])).alias("tokens"))
    return rows.join(ordered, "_row", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))).drop("_row")
