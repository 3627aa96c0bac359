import pytest

from lorespark.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_bytes(b"hello")
    (tmp_path / "in" / "deep" / "b.txt").write_bytes(b"12345678")
    got = {r["name"]: bytes(r["content"]) for r in files.read_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": b"hello", "b.txt": b"12345678"}
    assert files.measure(spark, str(tmp_path / "in")) == (13, True) and files.measure(spark, str(tmp_path / "none")) == (0, True)


def test_json(spark, tmp_path):
    assert files.read_json_or_none(spark, str(tmp_path / "x.json")) is None
    (tmp_path / "x.json").write_text(" \n")
    assert files.read_json_or_none(spark, str(tmp_path / "x.json")) is None
    (tmp_path / "y.json").write_text('{"a": [1]}')
    assert files.read_json_or_none(spark, str(tmp_path / "y.json")) == {"a": [1]}


def test_log(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "at string, message string"
    assert files.tail_log(spark, path, schema).count() == 0
    for i in range(3):
        files.append_log(spark.createDataFrame([(f"2024-01-0{i + 1}", f"m{i}")], schema), path)
    (tmp_path / "log" / "part-torn.json").write_text('{"at": "2024-01-09", "mess')
    assert [r["message"] for r in files.tail_log(spark, path, schema, n=2).collect()] == ["m1", "m2"]
    with pytest.raises(Exception):
        files.read_json_or_none(spark, str(tmp_path / "log" / "part-torn.json"))


def test_a_log_of_several_files(spark, tmp_path):
    """Lines go on from file to file by name; only the last file's end may be torn."""
    import pytest

    from lorespark.sources import snapshots

    for name, text in (("part-00000", '{"id": 1}\n{"id": 2}\n'), ("part-00001", "\n" * 400 + '{"id": 3}\n{"i')):
        (tmp_path / name).write_text(text)
    rows, torn = snapshots.read_log(spark, str(tmp_path), "id long")
    assert [r["id"] for r in rows.collect()] == [1, 2, 3] and torn == 1
    (tmp_path / "part-00002").write_text('{"id": 4}\n')
    with pytest.raises(ValueError):
        snapshots.read_log(spark, str(tmp_path), "id long")
