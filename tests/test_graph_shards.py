"""The graph over vectors that are spread evenly, and over more nodes than a shard holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import graph_index


@pytest.mark.parametrize("shard", [8_192, 1_000])
def test_recall_of_evenly_spread_vectors(spark, monkeypatch, shard):
    monkeypatch.setattr(graph_index, "SHARD", shard)
    x = np.random.default_rng(5).normal(size=(8_000, 64))
    x[4_001] = x[4_000]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    asked = rows.where("id % 80 = 0").select(F.col("id").alias("query_id"), "vector")
    graph = graph_index.build(rows)
    hits, work = graph_index.search(graph, asked, 8)
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in hits.collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit[::80] @ unit.T
    exact = {(80 * i, int(j)) for i, row in enumerate(near) for j in np.argsort(-row, kind="stable")[:8]}
    assert len(got) == 800 and graph.shards == -(-7_999 // shard)
    assert len(exact & {(q, i) for (q, _), (i, _) in got.items()}) >= 0.9 * len(exact)
    assert all(s == pytest.approx(float(near[q // 80, i]), abs=1e-5) for (q, _), (i, s) in got.items() if s)
    assert {got[4_000, 1][0], got[4_000, 2][0]} == {4_000, 4_001}
    scored = [r["scored"] for r in work.collect()]
    assert len(scored) == 100 and max(scored) < 8_000
