import zlib

import pytest

from lorespark.operators import pdf as P


def make(pages, extra=b"", packed=True):
    """A small file: each page is a list of (x, y, size, text)."""
    objects, kids = {}, []
    for i, texts in enumerate(pages):
        body = b"BT\n" + b"".join(b"/F1 %g Tf 1 0 0 1 %g %g Tm (%s) Tj\n" % (s, x, y, t.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)")) for x, y, s, t in texts) + b"ET"
        data = zlib.compress(body) if packed else body
        kids.append(10 + 2 * i)
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 5 0 R >> >> >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< %s >>\nstream\n%s\nendstream" % (b"/Filter /FlateDecode" if packed else b"", data)
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = b"<< /Type /Pages /Kids [%s] >>" % b" ".join(b"%d 0 R" % k for k in kids)
    objects[5] = b"<< /Type /Font /BaseFont /Helvetica >>"
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in sorted(objects.items())) + extra


def text(pages, **k):
    return P.pdf_to_markdown(P.runs_of(make(pages, **k))[0])


@pytest.mark.parametrize("packed", [True, False])
def test_headings_and_paragraphs(packed):
    page = [(50, 700, 20, "Title (1)"), (50, 660, 14, "Part"), (50, 640, 10, "First line of text that is long"), (50, 628, 10, "and the second"), (50, 590, 10, "New paragraph")]
    assert text([page, [(50, 700, 10, "Next page")]], packed=packed) == "# Title (1)\n\n## Part\n\nFirst line of text that is long\nand the second\n\nNew paragraph\n\nNext page\n"


def test_table_and_columns():
    rows = [(x, 700 - 14 * r, 10, f"c{r}{i}") for r in range(4) for i, x in enumerate((50, 200, 350))]
    assert text([rows]) == "| c00 | c01 | c02 |\n| --- | --- | --- |\n| c10 | c11 | c12 |\n| c20 | c21 | c22 |\n| c30 | c31 | c32 |\n"
    lines = [[P.Run(1, 50 + j * 250 + (i % 2) * 0, 700 - 12 * i, 150 - 9 * i * j, 10, f"{'lr'[j]}{i}") for j in range(2)] for i in range(4)]
    left, right = P.columns_of(lines)
    assert [P.line_text(x) for x in left] == ["l0", "l1", "l2", "l3"] and [P.line_text(x) for x in right] == ["r0", "r1", "r2", "r3"]


def test_refusals():
    assert P.preflight(b"no") == "not a PDF file" and "encrypted" in P.preflight(make([[(1, 1, 9, "x")]], extra=b"trailer << /Encrypt 9 0 R >>"))
    assert "scan" in P.preflight(make([[]])) and P.preflight(make([[], [(1, 1, 9, "x")]])) is None
    assert "no pages" in P.preflight(b"%PDF-1.4\n") and P.converted_pdf(make([[], []]))[3] is True
    assert P.runs_of(make([[(1, 1, 9, "a")], [(1, 1, 9, "b")]]), pages=1)[1] is True


def test_to_unicode_and_arrays():
    cmap = b"1 beginbfchar <01> <4E2D> endbfchar 1 beginbfrange <02> <03> <0041> endbfrange"
    font = P._to_unicode(cmap)
    runs = P._page_runs(1, b"BT /F 10 Tf 5 5 Td [<0102> -3000 <03>] TJ T* (\x01) ' Tj ET", {b"F": font})
    assert [r.text for r in runs] == ["中A", "B", "中"] and P.body_size(runs) == 10.0


def test_files(spark):
    rows = [("a.pdf", make([[(50, 700, 20, "T"), (50, 650, 10, "body text here")]])), ("b.PDF", b"junk"), ("c.md", b"x")]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary")
    got = {r["name"]: r for r in P.convert_pdfs(df).collect()}
    assert set(got) == {"a.pdf", "b.PDF"} and got["a.pdf"]["structure"] == "inferred" and got["a.pdf"]["text"].startswith("# T\n") and got["b.PDF"]["failed"]


def test_tags():
    draw = lambda tag, x, y, t: b"/%s <</MCID 0>> BDC BT /F1 10 Tf 1 0 0 1 %d %d Tm (%s) Tj ET EMC\n" % (tag, x, y, t)
    body = draw(b"H2", 50, 700, b"Small heading") + draw(b"P", 50, 680, b"some text") + draw(b"Span", 50, 668, b"goes on")
    body += b"".join(draw(b"TD", x, y, b"c%d%d" % (x, y)) for y in (640, 626) for x in (50, 200))
    runs = P._page_runs(1, b"/Document BMC " + body + b"EMC", {})
    assert P.is_tagged(runs) and {r.tag for r in runs} == {"H2", "P", "Span", "TD"}
    assert P.pdf_to_markdown(runs) == "## Small heading\n\nsome text\ngoes on\n\n| c50640 | c200640 |\n| --- | --- |\n| c50626 | c200626 |\n"
