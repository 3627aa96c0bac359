"""Vector storage for large collections: quantized codes, and cells of a k-means partitioning that queries probe.

Cells are a column: an index written with ``partitionBy("cell")`` lets Spark read only the folders that the queries probe.
Every row is indexed; only the centres are fitted on a sample, of SAMPLE rows at most.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import retrieval

LISTS, ITERATIONS = 10, 10
#: Cells that a query reads, for a recall of at least 0.9 where vectors are spread evenly.
PROBES = 8
SAMPLE = 100_000
QUANTIZERS = ("none", "FP16", "INT8", "INT4")


# Codes


def _half(x: Column) -> Column:
    """The 16 bits of the nearest half-precision number, as a smallint; what is too large becomes the largest."""
    size = F.least(F.abs(x), F.lit(65504.0))
    power = F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(1.0))), F.lit(-14))
    bits = (power + 14) * 1024 + F.rint(size / F.pow(F.lit(2.0), power - 10))
    return F.when(size == 0, 0).when(x < 0, bits - 32768).otherwise(bits).cast("smallint")


def _from_half(c: Column) -> Column:
    bits = F.when(c < 0, c.cast("int") + 32768).otherwise(c.cast("int"))
    power, rest = F.floor(bits / 1024), bits % 1024
    size = F.when(power == 0, rest * 2.0**-24).otherwise((1024 + rest) * F.pow(F.lit(2.0), power - 25))
    return F.when(c < 0, -size).otherwise(size)


def encoded(chunks: DataFrame, quantizer: str = "INT8") -> DataFrame:
    """(id, size, scale, codes) of chunks (id, vector).

    FP16 keeps 16 bits of each component, INT8 a byte, INT4 half a byte (two components in one), ``none`` the floats; the integer
    codes are parts of the largest component. Null vectors have null codes.
    """
    if quantizer not in QUANTIZERS:
        raise ValueError(f"quantizer is one of {', '.join(QUANTIZERS)}")
    v = F.col("vector").cast("array<double>")
    most = {"INT8": 127.0, "INT4": 7.0}.get(quantizer)
    scale = F.array_max(F.transform(v, F.abs)) / most if most else F.lit(1.0)
    step = lambda x: F.when(F.col("scale") > 0, F.round(x / F.col("scale"))).otherwise(0).cast("int")
    rows = chunks.select("id", F.size(v).alias("size"), scale.alias("scale"), v.alias("v"))
    if quantizer == "none":
        codes = F.col("v").cast("array<float>")
    elif quantizer == "FP16":
        codes = F.transform("v", _half)
    elif quantizer == "INT8":
        codes = F.transform("v", lambda x: step(x).cast("tinyint"))
    else:
        pair = lambda i: step(F.get("v", i * 2)) * 16 + F.pmod(F.coalesce(step(F.get("v", i * 2 + 1)), F.lit(0)), F.lit(16))
        places = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / 2).cast("int") - 1, F.lit(0)))
        codes = F.when(F.col("size") > 0, F.transform(places, lambda i: pair(i).cast("tinyint"))).otherwise(F.array().cast("array<tinyint>"))
        codes = F.when(F.col("v").isNotNull(), codes)
    return rows.select("id", "size", "scale", codes.alias("codes"))


def decoded(codes: DataFrame, quantizer: str = "INT8") -> DataFrame:
    """(id, vector) of what ``encoded`` gave."""
    if quantizer == "FP16":
        v = F.transform("codes", _from_half)
    elif quantizer == "INT4":
        low = lambda c: F.pmod(c.cast("int"), F.lit(16))
        signed = lambda n: F.when(n >= 8, n - 16).otherwise(n).cast("double")
        both = F.flatten(F.transform("codes", lambda c: F.array((c.cast("int") - low(c)) / 16, signed(low(c)))))
        v = F.transform(F.slice(both, F.lit(1), F.greatest(F.col("size"), F.lit(0))), lambda x: x * F.col("scale"))
    else:
        v = F.transform("codes", lambda x: x.cast("double") * F.col("scale"))
    return codes.select("id", v.alias("vector"))


def rescored(chunks: DataFrame, queries: DataFrame, k: int, quantizer: str = "INT8", oversample: int = 4) -> DataFrame:
    """Dense search over the codes; the best k * oversample of each query are scored again on the vectors."""
    near = retrieval.dense(decoded(encoded(chunks, quantizer), quantizer), queries, k * oversample).select("query_id", "id")
    q = retrieval._few(queries.select("query_id", F.col("vector").cast("array<double>").alias("q")))
    exact = near.join(chunks.select("id", F.col("vector").cast("array<double>").alias("v")), "id").join(q, "query_id")
    scored = exact.select("query_id", "id", T.match_score(1 - T.cosine("v", "q")).alias("score"))
    return retrieval.ranked(scored, [F.desc(F.round("score", 9)), "id"], k)


# Cells


def fit_cells(chunks: DataFrame, lists: int = LISTS, iterations: int = ITERATIONS, sample: int = SAMPLE, seed: int = 7) -> KMeansModel:
    """Centres by cosine of at most ``sample`` chunks (id, vector), those of the least hashes of their ids."""
    usable = chunks.where("exists(vector, x -> x <> 0) and forall(vector, x -> x is not null and not isnan(x))")
    some = usable.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"), F.xxhash64("id").alias("_h")).orderBy("_h").limit(sample)
    return KMeans(k=lists, maxIter=iterations, seed=seed, distanceMeasure="cosine", initMode="k-means||").fit(some.select("features"))


def celled(chunks: DataFrame, model: KMeansModel) -> DataFrame:
    """Chunks with the cell of their vector; vectors without a direction are in cell -1, which every query probes."""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    return chunks.withColumn("cell", F.coalesce(F.get(_nearest(F.col("vector").cast("array<double>"), centres, 1), 0), F.lit(-1)))


def _nearest(v: Column, centres: Column, n: int) -> Column:
    """The n cells whose centres are nearest to a vector by cosine."""
    scores = F.transform(centres, lambda c, i: F.struct((-T.cosine(v, c)).alias("d"), i.alias("cell")))
    fit = F.filter(scores, lambda s: s["d"].isNotNull() & ~F.isnan(s["d"]))
    return F.transform(F.slice(F.array_sort(fit), 1, n), lambda s: s["cell"])


def probed(cells: DataFrame, model: KMeansModel, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
    """(query_id, id, score, rank): the k nearest chunks (id, vector, cell) in the cells that each query probes."""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))
    asked = q.select("query_id", "q", F.explode(F.concat(F.array(F.lit(-1)), _nearest(F.col("q"), centres, probes))).alias("cell"))
    return retrieval.nearest(cells.select("id", "cell", F.col("vector").cast("array<double>").alias("v")), asked, ["cell"], k)


def write_cells(cells: DataFrame, path: str) -> None:
    """The index on disk, a folder for each cell; a hot cell is dealt over several files."""
    cells.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("cell").parquet(path)
