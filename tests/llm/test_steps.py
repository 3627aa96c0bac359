"""What steps between tables cost: rounds of components, files of small tables."""

import glob

from lorespark.llm import common, near_dedup


def test_stars_need_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(common, "stored", lambda df, name, files=None, put=common.stored: written.append(name) or put(df, name, files))
    edges = spark.createDataFrame([(i, 0) for i in range(1, 50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(edges, "stars").collect()}
    assert got == {i: 0 for i in range(50)} | {100: 100, 101: 100}
    assert written == ["stars"]


def test_small_steps_are_few_files(spark, monkeypatch):
    many = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, made = {k: spark.conf.get(k) for k in many}, {}

    def counted(df, name, *files, put=common.stored):
        out = put(df, name, *files)
        made[name] = len(glob.glob(f"{out._stored_path.removeprefix('file:')}/part-*"))
        return out

    for module in (common, near_dedup):
        monkeypatch.setattr(module, "stored", counted)
    texts = [" ".join(f"w{i // 4}x{j}" for j in range(60)) + f" end{i % 4}" for i in range(400)]
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        rows = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: i // 4 * 4 for i in range(400)}
    assert max(made.values()) <= max(common.FILES_A_CORE * spark.sparkContext.defaultParallelism, 1) < 90, made
