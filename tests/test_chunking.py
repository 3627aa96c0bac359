import time

import pytest

from lorespark.operators.chunking import Config, chunk_documents, chunks_of, register_chunk_function, tokens_of

SMALL = Config("heading", 200, 12, 5)


def texts(text, config=SMALL):
    return [r[1] for r in chunks_of(text, config)[0]]


def test_tokens():
    assert tokens_of("") == 0 and tokens_of("abcd") == 1 and tokens_of("abcde") == 2
    assert tokens_of("中文ab") == 3 and tokens_of("😀") == 1 and tokens_of("\U00020000") == 1


def test_parent_headings_reach_the_chunks():
    text = "# Manual\n\n## Install\n\n### Windows\n\n" + "Run the installer and wait until it ends. " * 4
    got = chunks_of(text, SMALL)[0]
    assert len(got) == 1 and got[0][1].startswith("# Manual\n## Install\n\n### Windows") and got[0][3] == 0
    assert got[0][6] == "Manual › Install › Windows"


def test_headings_at_the_end_stay():
    text = "# A\n\n" + "word " * 60 + "\n\n# B"
    assert [t for t in texts(text)][-1].strip() == "# B"


def test_heading_inside_fence_is_code():
    text = "# Real\n\n```sh\n# comment\nls\n```\n\n" + "text " * 50
    assert {r[6] for r in chunks_of(text, SMALL)[0]} == {"Real"}


def test_line_ends_make_no_difference():
    text = "# T\n\nbody of the first part is here\n\n## U\n\nbody of the second part is here\n"
    assert chunks_of(text, SMALL) == chunks_of(text.replace("\n", "\r\n"), SMALL) == chunks_of(text.replace("\n", "\r"), SMALL)


def test_table_rows_stay_whole_under_a_repeated_header():
    rows = "\n".join(f"| region {i} | {i * 1000} sold |" for i in range(40))
    text = "# Sales\n\n| area | amount |\n| --- | --- |\n" + rows
    got = texts(text, Config("heading", 120, 12, 5, True, True))
    assert len(got) > 2
    tables = [t for t in got if "region" in t]
    assert all("| area | amount |\n| --- | --- |" in t for t in tables)
    assert sum(t.count("| region") for t in tables) == 40
    assert all(line.startswith("|") and line.endswith("|") for t in tables for line in t[t.index("| area") :].split("\n") if line)


def test_overlap_is_shared_text_and_windows_end():
    text = "The quick brown fox jumps over the lazy dog. " * 200
    got = chunks_of(text, Config("fixed", 100, 20, 1))[0]
    for a, b in zip(got, got[1:]):
        assert b[3] < a[4] and b[5] >= 20 and text[b[3] : b[4]] == b[1]
    assert got[-1][4] == len(text) and len(got) < 40


def test_windows_without_a_place_to_cut():
    got = chunks_of("x" * 5000, Config("fixed", 100, 0, 0))[0]
    assert [r[4] - r[3] for r in got] == [400] * 12 + [200]


def test_code_blocks_stay_whole_and_get_no_overlap():
    code = "```py\n" + "x = 1\n" * 20 + "```"
    got = texts("intro text " * 30 + "\n" + code + "\n" + "outro text " * 30, Config("fixed", 120, 10, 1))
    assert code in got


def test_small_pieces_are_counted_not_kept():
    rows, dropped = chunks_of("one\n\n" + "long enough to keep " * 10, Config("paragraph", 200, 0, 10))
    assert len(rows) == 1 and dropped == 1


@pytest.mark.parametrize("text", ["", " \n \r\n ", "😀" * 3000, "中" * 3000, "#" * 50, "```", "|\n|-|"])
def test_odd_texts(text):
    for mode in ("heading", "paragraph", "fixed"):
        for r in chunks_of(text, Config(mode, 100, 10, 1, True, True))[0]:
            assert r[2] <= 100 or "|" in r[1]


def test_cost_is_linear():
    def cost(n):
        start = time.process_time()
        chunks_of("A sentence of some length, repeated. " * n, Config("fixed", 200, 12, 5))
        return time.process_time() - start

    cost(400)
    assert cost(6400) < 24 * max(cost(400), 1e-3)


def test_bad_settings():
    for bad in (("other",), ("fixed", 0), ("fixed", 10, 10), ("fixed", 10, 2, 11)):
        with pytest.raises(ValueError):
            Config(*bad)


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a" * 900, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, chunk_id string")
    got = chunk_documents(docs, Config("fixed", 100, 10, 1)).orderBy("ordinal").collect()
    assert [r["chunk_id"] for r in got] == ["1#0", "1#1", "1#2"] and {r["doc_id"] for r in got} == {1}


def test_table_function(spark):
    docs = spark.createDataFrame([(1, "# A\n\nbody " * 60), (2, None), (3, "plain")], "doc_id long, text string")
    docs.createOrReplaceTempView("texts_to_chunk")
    register_chunk_function(spark)
    got = spark.sql("SELECT d.doc_id, c.* FROM texts_to_chunk d, LATERAL chunk(d.text, 'heading', 50, 5, 1) c").collect()
    want = chunk_documents(docs, Config("heading", 50, 5, 1)).collect()
    assert sorted((r["doc_id"], r["ordinal"], r["text"], r["char_start"]) for r in got) == sorted((r["doc_id"], r["ordinal"], r["text"], r["char_start"]) for r in want) and len(got) > 2


def test_ids_beside_a_null(spark):
    docs = spark.createDataFrame([(2**60 + 1, "one text"), (None, "another text")], "doc_id long, text string")
    got = {r["text"]: (r["doc_id"], r["chunk_id"]) for r in chunk_documents(docs, Config("fixed", 50, 0, 0)).collect()}
    assert got == {"one text": (2**60 + 1, f"{2**60 + 1}#0"), "another text": (None, "0")}
