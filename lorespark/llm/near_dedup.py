"""MinHash near-dedup by HyperMinHash sketches.

A document's set of word shingles is hashed once into buckets. A bucket keeps the least hash, compressed to
its count of leading zeros and the ten bits that follow (16 bits in all). Buckets that stay empty are filled in
further rounds, as in fast similarity sketching, so that a register agrees with the probability of the Jaccard
similarity whether a text has three words or a million.

Registers are banded; documents that share a band's key are candidates. Work per bucket stays bounded:

1. equal sets are one representative from here on, however many copies there are;
2. each member of a bucket is compared with the bucket's centre, the member that meets most others in its buckets (a star,
   not all pairs), the similarity is estimated from the registers less the collisions that compression makes,
   and what may reach the threshold is confirmed on the full sets;
3. only members that are still in different components are paired within their buckets, which is exact: a link
   inside one component can't change any component. A pair meets only if the shingles that each has in common with any other
   component leave the threshold within reach, so that a large group of copies edited in many ways doesn't give all its pairs.

A pair of similarity 0.8 shares no band with probability (1 - 0.8^ROWS)^BANDS, below 1e-6.
Null, empty and blank texts have empty sets and are linked with nothing. Rows that repeat a doc_id are one document,
linked by the least of their texts; each row keeps its own count. Rows without a doc_id have no component and are kept.
Other columns of the input are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from .common import components, discard, files_like, id_column, stored, text_batches, with_nulls
from .words import mix, shingles

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Sets whose registers are filled together.
SKETCHED = 64
#: Estimates this far below the threshold still go to the exact check (5 standard deviations).
SLACK = 0.145
_SALT = mix(np.arange(1, 200_000, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """m compressed minima (uint16) of each of some sets of well mixed, sorted 64-bit hashes, none empty; all sets are filled together."""
    n, sizes = len(sets), np.array([len(h) for h in sets], np.int64)
    regs, empty = np.zeros(n * m, np.uint16), np.ones(n * m, bool)
    if not n:
        return regs.reshape(0, m)
    flat, starts = np.concatenate(sets), np.r_[0, np.cumsum(sizes)[:-1]]
    low32, big = np.uint64(0xFFFFFFFF), np.uint64(m)

    def bucket(g):
        return (((g >> np.uint64(32)) * big + (((g & low32) * big) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)

    def fill(place, value, which):
        v = value | np.uint64(1)
        zeros = (64 - np.frexp(v.astype(np.float64))[1]).clip(0, 63).astype(np.uint64)
        top = (v << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
        regs[place] = ((zeros << np.uint64(MANTISSA)) | top).astype(np.uint16) ^ (which.astype(np.uint32) * np.uint32(0x9E35)).astype(np.uint16)
        empty[place] = False

    place = np.repeat(np.arange(n) * m, sizes) + bucket(flat)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # hashes are sorted, so a bucket's least comes first
    fill(place[first], flat[first] * big, np.zeros(len(first), np.int64))
    rounds, at = np.clip(2 * m // sizes, 1, 400), np.ones(n, np.int64)
    while len(todo := np.flatnonzero(empty.reshape(n, m).any(axis=1))):
        each = sizes[todo] * rounds[todo]
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        doc = np.repeat(todo, each)
        which = at[doc] + k // sizes[doc]
        g = mix(flat[starts[doc] + k % sizes[doc]] ^ _SALT[which])
        place = doc * m + bucket(g)
        some = np.flatnonzero(empty[place])
        place, which, value = place[some], which[some], g[some] * big
        order = np.lexsort((value, which, place))
        first = order[np.flatnonzero(np.r_[True, place[order][1:] != place[order][:-1]])] if len(order) else order
        fill(place[first], value[first], which[first])
        at[todo] += rounds[todo]
    return regs.reshape(n, m)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key (int64) of each band's registers and its number, for rows of registers."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)), r.shape[:2])
    for i in range(0, ROWS, 4):
        part = sum((r[:, :, i + j] << np.uint64(16 * j) for j in range(min(4, ROWS - i))), np.zeros_like(key))
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.astype(np.int64)


def _collisions() -> np.ndarray:
    """Probability that registers of disjoint sets of 2^i and 2^j elements agree, from the compressed minima's distribution."""
    edges = np.concatenate([2.0 ** -(z + 1) * (1 + np.arange(2**MANTISSA) / 2**MANTISSA) for z in range(63, -1, -1)] + [[1.0]])
    chance = []
    for i in range(31):
        load = max(2.0**i / REGISTERS, 1.0)
        chance.append(np.exp(-load * edges[:-1]) - np.exp(-load * edges[1:]))
    c = np.array(chance)
    return c @ c.T


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (pairs x REGISTERS), less the share that collides by chance."""
    same = (ra == rb).mean(axis=1)
    c = chance[np.log2(np.maximum(na, 1)).round().astype(int).clip(0, 30), np.log2(np.maximum(nb, 1)).round().astype(int).clip(0, 30)]
    return (same - c) / (1 - c)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2: digest of the set, regs: binary, bands: keys) of each row."""
    text_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            sets = [shingles(t, k) for t in pdf["text"]]
            full = [i for i, h in enumerate(sets) if len(h)]
            regs, bands = np.full(len(sets), None, object), np.full(len(sets), None, object)
            for at in range(0, len(full), SKETCHED):
                some = full[at : at + SKETCHED]
                made = registers([sets[i] for i in some])
                for i, r, key in zip(some, made, band_keys(made)):
                    regs[i], bands[i] = r.tobytes(), key
            digests = [xxh3_128_intdigest(h.tobytes()) if len(h) else 2**127 + 2**63 for h in sets]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "n": np.array([len(h) for h in sets], np.int64), "d1": np.array([(d >> 64) - 2**63 for d in digests], np.int64),
                "d2": np.array([(d & (2**64 - 1)) - 2**63 for d in digests], np.int64), "regs": regs, "bands": bands,
            })

    return with_nulls(docs.select(id_column(), "text").mapInPandas(run, "doc_id long, n long, d1 long, d2 long, regs binary, bands array<long>"))


def _estimated(pairs: DataFrame, regs: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose estimated similarity may reach the threshold."""
    left = regs.select(F.col("rep").alias("a"), F.col("regs").alias("ra"))
    right = regs.select(F.col("rep").alias("b"), F.col("regs").alias("rb"))
    chance = _collisions()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                ra, rb = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(len(pdf), -1) for c in ("ra", "rb"))
                est = estimate(ra, rb, pdf["na"].to_numpy(), pdf["nb"].to_numpy(), chance)
                yield pdf.loc[est >= percent / 100 - SLACK, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb").coalesce(tasks).mapInPandas(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 |A and B| >= percent |A or B| on the full sets."""

    def run(batches):
        seen: dict = {}

        def of(i, t):
            if i not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[i] = shingles(t, k)
            return seen[i]

        for pdf in batches:
            keep = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                x, y = of(a, ta), of(b, tb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def _in_common(placed: DataFrame, texts: DataFrame, k: int, files: int) -> DataFrame:
    """(rep, home, s, h): how many shingles of each document (rep, component, home) documents of another component have too,
    and how many of these its home lacks."""

    def run(batches):
        for pdf in batches:
            yield pdf.drop(columns="text").assign(g=[shingles(t, k).astype(np.int64) for t in pdf["text"]])

    rows = placed.join(texts, "rep").select("rep", "component", "home", "text").coalesce(files).mapInPandas(run, "rep long, component long, home long, g array<long>")
    rows = stored(rows, "near-shingles").select("rep", "component", "home", F.explode("g").alias("g"))
    several = rows.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("g")
    homes = placed.select("home").distinct().join(texts.select(F.col("rep").alias("home"), "text"), "home")
    homes = homes.select(F.lit(0).cast("long").alias("rep"), F.lit(0).cast("long").alias("component"), "home", "text").coalesce(files).mapInPandas(run, "rep long, component long, home long, g array<long>")
    homes = homes.select("home", F.explode("g").alias("g"), F.lit(1).alias("in_home"))
    shared = rows.join(several, "g").join(homes, ["home", "g"], "left")
    return shared.groupBy("rep", "home").agg(F.count("*").alias("s"), F.count_if(F.col("in_home").isNull()).alias("h"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text).

    Links are pairs of sets of k-word shingles with 100 * intersection >= percent * union; component_id is
    the smallest doc_id reachable, kept marks it. ``percent`` of 80 or more suits the bands here.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = every_row = stored(sketches(docs, k), "near-sketches")
    docs = docs.where("doc_id is not null")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        sk = stored(sketches(docs, k), "near-sketches")
    files = files_like(sk)
    kept = lambda df, name: stored(df, name, files)
    full = sk.where("n > 0 and doc_id is not null")
    #: Written first, so that the join below has shuffles of its own and Spark can split a large group of copies.
    groups = kept(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "near-groups")
    member = kept(full.select("doc_id", "d1", "d2").join(groups.where("copies > 1"), ["d1", "d2"]).select("doc_id", "rep"), "near-members")
    reps = kept(full.join(groups.select("rep"), F.col("doc_id") == F.col("rep")).select("rep", "n", "regs", "bands"), "near-reps")

    rows = reps.select(F.posexplode("bands").alias("band", "key"), "rep", "n")
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = kept(rows.join(shared, "key"), "near-buckets")
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"

    used = buckets.groupBy("rep").agg(F.sum("c").alias("met"), F.first("n").alias("n"))
    used = kept(used, "near-used")
    regs = kept(reps.select("rep", "regs").join(used.select("rep"), "rep"), "near-regs")
    texts = kept(docs.join(used, docs.doc_id == used.rep).select("rep", "text"), "near-texts")

    placed = buckets.select("key", "rep", "n").join(used.select("rep", "met"), "rep")
    centres = placed.groupBy("key").agg(F.max(F.struct("met", -F.col("rep"), "n")).alias("m")).select("key", (-F.col("m.col2")).alias("b"), F.col("m.n").alias("nb"), F.col("m.met").alias("met_b"))
    placed = placed.join(centres, "key")
    homes = placed.groupBy("rep").agg(F.max(F.struct("met_b", -F.col("b"))).alias("m")).select("rep", (-F.col("m.col2")).alias("home"))
    homes = kept(homes, "near-homes")
    star = placed.where("rep <> b").select(F.col("rep").alias("a"), "b", F.col("n").alias("na"), "nb").where(near).distinct()
    links = kept(_confirmed(_estimated(star, regs, percent, files), texts, k, percent), "near-links")
    comp = kept(components(links, "near-star", files), "near-comp")

    placed = buckets.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    opened = kept(placed.join(open_, "key").select("key", "band", "rep", "n", "component"), "near-open")
    common = kept(_in_common(opened.select("rep", "component").distinct().join(homes, "rep"), texts, k, files), "near-common")
    rest = opened.join(common, "rep").where(f"100 * s >= {percent} * n").join(reps.select("rep", "bands"), "rep")
    side = lambda x: rest.select("key", *[F.col(c).alias(c + x) for c in ("rep", "n", "component", "home", "s", "h")], F.slice("bands", F.lit(1), F.col("band")).alias("earlier" + x))
    #: At most so many shingles can be in common: within the home of both, and beside it.
    most = "CASE WHEN homea = homeb THEN least(sa - ha, sb - hb) + least(ha, hb) ELSE least(sa, sb) END"
    reach = f"componenta < componentb AND {near} AND 100 * ({most}) >= {percent} * (na + nb - ({most})) AND NOT arrays_overlap(earliera, earlierb)"
    cross = side("a").join(side("b"), "key").where(reach).select(F.col("repa").alias("a"), F.col("repb").alias("b"), "na", "nb")
    more = kept(_confirmed(_estimated(cross, regs, percent, files), texts, k, percent), "near-more")

    #: Copies follow their representative; only representatives have links.
    linked = comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    final = kept(components(linked, "near-all", files), "near-final").withColumnRenamed("node", "rep")
    for done in (groups, reps, buckets, used, homes, regs, texts, links, comp, opened, common, more):
        discard(done)
    out = every_row.select("doc_id", F.col("n").alias("n_shingles")).join(member, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(final, "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select("doc_id", "n_shingles", "component_id", "kept")
