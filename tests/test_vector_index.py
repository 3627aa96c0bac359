import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import retrieval as R
from lorespark.operators import vector_index as V


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 15))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.3 * rng.normal(size=15)]) for i in range(600)] + [(900, [0.0] * 15), (901, None)]
    return spark.createDataFrame(rows, "id long, vector array<double>").cache()


@pytest.mark.parametrize("kind,off", [("none", 1e-6), ("FP16", 1e-3), ("INT8", 0.02), ("INT4", 0.35)])
def test_codes_come_back(chunks, kind, off):
    got = {r["id"]: r["vector"] for r in V.decoded(V.encoded(chunks, kind), kind).collect()}
    for r in chunks.collect():
        if r["vector"] is None:
            assert got[r["id"]] is None
        else:
            assert len(got[r["id"]]) == 15 and np.abs(np.array(got[r["id"]]) - r["vector"]).max() < off
    with pytest.raises(ValueError):
        V.encoded(chunks, "PQ")


def test_half_precision_is_exact(spark):
    values = [0.0, 1.0, -1.0, 0.1, 65504.0, 1e9, -1e9, 6e-8, 2.0**-24, 5.9e-5, 1023.7, 2047.9, -3.14159]
    df = spark.createDataFrame([(1, values)], "id long, vector array<double>")
    coded = V.encoded(df, "FP16")
    want = np.clip(np.array(values), -65504, 65504).astype(np.float16)
    assert coded.first()["codes"] == want.view(np.int16).tolist()
    assert V.decoded(coded, "FP16").first()["vector"] == [float(x) for x in want]


@pytest.mark.parametrize("kind", ["INT4", "INT8", "FP16"])
def test_rescored_finds_the_nearest(chunks, kind):
    q = chunks.where("id < 5").select(F.col("id").alias("query_id"), "vector")
    want = {(r["query_id"], r["id"]) for r in R.dense(chunks, q, 8).collect()}
    got = {(r["query_id"], r["id"]) for r in V.rescored(chunks, q, 8, kind, 8).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_cells(spark, chunks, tmp_path):
    model = V.fit_cells(chunks, lists=6, sample=300)
    cells = V.celled(chunks, model)
    placed = {r["id"]: r["cell"] for r in cells.collect()}
    assert len(placed) == 602 and placed[900] == placed[901] == -1 and {placed[i] for i in range(600)} == set(range(6))
    V.write_cells(cells, str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    q = chunks.where("id < 5").select(F.col("id").alias("query_id"), "vector")
    want = [tuple(r) for r in R.dense(chunks, q, 8).select("query_id", "id", "rank").orderBy("query_id", "rank").collect()]
    every = [tuple(r) for r in V.probed(stored, model, q, 8, 6).select("query_id", "id", "rank").orderBy("query_id", "rank").collect()]
    assert every == want
    few = {(r["query_id"], r["id"]) for r in V.probed(stored, model, q, 8, 2).collect()}
    assert len(few & {w[:2] for w in want}) >= 0.9 * len(want)


def test_recalls_count_codes_and_cells(spark):
    """The report holds every kind of index, cells too."""
    from lorespark.plans import registry

    got = {r["index"]: r for r in registry.queries()["index_recalls"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {"FP16", "INT8", "INT4", "cells"} and all(r["enough"] and r["exact"] == got["FP16"]["exact"] for r in got.values())
