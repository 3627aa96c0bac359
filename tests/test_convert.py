import io
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lorespark.operators import convert as C


def graded(rng):
    """A document of random blocks in random order, and the grade that the rule gives for what was put in."""
    word = lambda: "".join(rng.choice("klmopqu") for _ in range(rng.randint(2, 7)))
    fence = rng.choice(["~~~", "```", "```sql"])
    blocks = {
        "prose": f"{word()} {word()}\n{word()}.",
        "heading": "#" * rng.randint(1, 6) + f" {word()}",
        "no heading": rng.choice([f"#{word()}", f"{'#' * 7} {word()}", f"{word()}\n---", f" # {word()}"]),
        "fence": f"{fence}\n{word()}\n{fence[:3]}",
        "fenced heading": f"{fence}\n# {word()}\n{fence[:3]}",
        "table": f"| {word()} | {word()} |\n|:--|---:|\n| {word()} | |",
        "no rule": f"| {word()} |\n| {word()} |",
        "no header": "| : | - |\n| --- | --- |",
    }
    chosen = rng.sample(list(blocks), rng.randint(0, 5))
    parts = [blocks[c] for c in chosen]
    if rng.random() < 0.15:  # an open fence hides what follows
        at = rng.randint(0, len(parts))
        cut, after = chosen[:at], chosen[at:]
        if not any(c in ("fence", "fenced heading") for c in after):
            parts.insert(at, fence)
            heads = "heading" in cut
        else:
            heads = "heading" in chosen
    else:
        heads = "heading" in chosen
    text = "\n\n".join(parts)
    if rng.random() < 0.1:
        return text + "\r\n", "flat-text"
    full = bool({"fence", "fenced heading", "table"} & set(chosen))
    return text, "flat-text" if not heads else "structured" if full else "inferred"


def test_grades_agree(spark):
    rng = random.Random(11)
    cases = [("", "flat-text"), *(graded(rng) for _ in range(400))]
    assert {g for _, g in cases} == {"flat-text", "inferred", "structured"}
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r["structure"] for r in C.grade(rows).orderBy("doc_id").collect()] == [g for _, g in cases]
    assert [C.grade_text(t) for t, _ in cases] == [g for _, g in cases]


def test_html():
    html = (
        '<!DOCTYPE html><html><head><title>no</title><script>var a="</p>";</script><style>p{}</style></head><body><!-- c --><h1>A <b>b</h1>'
        '<p>one<p>two <a href="JaVaScript:x()">bad</a> <a href="vbs&#x63;ript&colon;y">worse</a> <a href="http://k/">good</a><img src="data:x" alt="i">'
        '<ul><li>x<li>y</ul><table><tr><th>h1<th>h|2</tr><tr><td>1<td>2</table><pre><code class="language-ts">let a\n  = 1</code></pre></body></html>'
    )
    got = C.html_to_markdown(html)
    assert got == "# A b\n\none\n\ntwo bad worse [good](http://k/)\n\n- x\n- y\n\n| h1 | h｜2 |\n| --- | --- |\n| 1 | 2 |\n\n```ts\nlet a\n  = 1\n```\n"
    assert C.html_to_markdown("") == "" and C.html_to_markdown("<script>x") == ""
    assert C.html_to_markdown("<pre>a\r\nb</pre>") == "```\na\nb\n```\n"


def test_tables_and_csv():
    assert C.pipe_table([["a", "b"], ["1"], ["x|y", "p\nq", "z"]], "T") == "## T\n\n| a | b |  |\n| --- | --- | --- |\n| 1 |  |  |\n| x｜y | p q | z |"
    assert C.csv_to_markdown('﻿a,b\r\n1,"x|y"\r\n\r\n', "f").startswith("## f\n\n| a | b |\n| --- | --- |\n| 1 | x｜y |")
    with pytest.raises(ValueError):
        C.csv_to_markdown("\n\n", "f")


def test_json():
    assert C.json_to_markdown('{"a": 1}') == '```json\n{\n  "a": 1\n}\n```'
    assert C.json_to_markdown("{not json").startswith("```\n{not json")
    big = '{"s": {"k": "' + "v" * 9000 + '", "e": [], "o": {}, "l": [1, null, true]}}'
    got = C.json_to_markdown(big)
    assert got.startswith('## s\n\n- s.k: "vvv') and "- s.l[1]: null\n- s.l[2]: true" in got and "## s.e\n\n- (empty array)" in got and "(empty object)" in got
    deep = "[" * 60 + '"' + "x" * 9000 + '"' + "]" * 60
    assert "nested too deeply" in C.json_to_markdown(deep)


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


W = 'xmlns:w="urn:w"'


def test_docx():
    styles = f'<w:styles {W}><w:style w:styleId="a"><w:name w:val="标题 2"/></w:style><w:style w:styleId="b"><w:name w:val="x"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>'
    p = lambda s, t: f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    body = f"<w:document {W}><w:body>{p('b', 'Top')}{p('a', 'Sub')}{p('z', 'Text')}<w:tbl><w:tr><w:tc>{p('z', 'h')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    data = _zip(**{"word__styles.xml": styles, "word__document.xml": body})
    assert C.docx_to_markdown(data)[0] == "# Top\n\n## Sub\n\nText\n\n| h |\n| --- |\n"
    assert C.docx_to_markdown(data)[1] is True and C.converted("x.docx", data)[1] == "inferred"  # style z says nothing, so a heading may be lost
    image = f"<w:document {W}><w:body>{p('b', 'Top')}<w:p><w:r><w:drawing/></w:r></w:p></w:body></w:document>"
    assert C.docx_to_markdown(_zip(**{"word__styles.xml": styles, "word__document.xml": image})) == ("# Top\n\n![图片]()\n", False)


def test_xlsx():
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="S1" r:id="1"/><sheet name="S2" r:id="2"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="1" Target="worksheets/a.xml"/><Relationship Id="2" Target="worksheets/b.xml"/></Relationships>'
    a = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    b = '<worksheet><sheetData><row><c r="A1"><v>1</v></c></row></sheetData></worksheet>'
    data = _zip(**{"xl__workbook.xml": book, "xl___rels__workbook.xml.rels": rels, "xl__worksheets__a.xml": a, "xl__worksheets__b.xml": b, "xl__sharedStrings.xml": "<sst><si><t>one</t></si></sst>"})
    assert C.xlsx_to_markdown(data) == "## S1\n\n| one |  | 7 |\n| --- | --- | --- |\n|  | in |  |\n"


def test_cap():
    assert C.cap_bytes("añb", 2) == "a" and C.cap_bytes("añb", 3) == "añ" and C.cap_bytes("x", 0) == "" and C.cap_bytes("x", 9) == "x"


def test_files(spark):
    rows = [("a.md", b"\xef\xbb\xbf# T\r\nx"), ("b.html", b"<h1>T</h1>"), ("c.docx", b"broken"), ("d.exe", b"x"), ("e.csv", b""), ("f.json", b"null"), ("g.html", b"<script>1</script>"), ("h.txt", None)]
    files = spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in rows if c is not None], "name string, content binary")
    got = {r["name"]: r for r in C.convert_files(files).collect()}
    assert got["a.md"]["text"] == "# T\nx" and got["b.html"]["text"] == "# T\n" and got["f.json"]["text"] == "```json\nnull\n```"
    assert all(got[n]["failed"] and got[n]["error"] for n in ("c.docx", "d.exe", "e.csv", "g.html"))


def test_unsafe(spark):
    urls = ["javascript:x", " \tJavaScript:x", "data:a", "vbscript:", "http://x", "/a:b", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(C.is_unsafe_url(F.col("u")).alias("x"))
    assert [r["x"] for r in rows.collect()] == [True, True, True, True, False, False, False]


def test_unclosed_parts_cost_no_more_than_their_length(spark):
    start = time.perf_counter()
    for part in ("<!--", "<script>", "<style x", "<!-- a --><b>"):
        C.html_to_markdown("<p>kept</p>" + part * 60_000)
    assert time.perf_counter() - start < 20
    assert C.html_to_markdown("<p>kept</p><!-- a <!-- b <p>gone</p>") == "kept\n"
    with pytest.raises(TimeoutError), C.time_limit(0.2):
        while True:
            pass
    rows = spark.createDataFrame([("a<div><style>p{}</style>b<!-- x</div>",), ("<!--" * 50_000,), ("a<script>1</script\n>b",)], "h string")
    assert [r[0] for r in rows.select(C.stripped_html("h")).collect()] == ["a<div>b", "", "ab"]


def test_keys_beside_a_null(spark):
    rows = spark.createDataFrame([(2**60 + 1, "<p>a</p>"), (None, "<p>b</p>"), (7, None)], "page_id long, html string")
    got = {r["text"]: r["page_id"] for r in C.convert_html(rows, "page_id", "html").collect()}
    assert got == {"a\n": 2**60 + 1, "b\n": None, "": 7}


def test_bytes(spark):
    from lorespark.functions.text import format_bytes

    sizes = {-5: "0 B", 0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1.0 KB", 1587: "1.5 KB", 1588: "1.6 KB", 10239: "10.0 KB", 10240: "10 KB", 10752: "11 KB", 9 * 2**40: "9.0 TB", 5000 * 2**40: "5000 TB", None: None}
    rows = spark.createDataFrame(list(enumerate(sizes)), "i int, n long").orderBy("i").select(format_bytes("n").alias("s"))
    assert [r["s"] for r in rows.collect()] == list(sizes.values())
