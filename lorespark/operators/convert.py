"""Converters: HTML, tables, CSV, JSON, spreadsheets and word-processor files to Markdown, and the grade of what came out.

A document that can't be converted gives a row that says why; nothing raises for one document. Files are read by Spark
(``binaryFile``); each format goes through its own function, so rows that are text already never meet Python.
"""

from __future__ import annotations

import csv
import io
import json
import re
import signal
import threading
import zipfile
from collections import Counter
from contextlib import contextmanager
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.batches import bounded
from lorespark.functions import text as T

RESULT = "text string, structure string, truncated boolean, failed boolean, error string"
TEXT_LIMIT = 16 * 1024 * 1024
JSON_FENCE_LIMIT = 8 * 1024
JSON_DEPTH = 32
#: What stands for an image of a word-processor file (fixed value).
IMAGE = "![图片]()"


# In the JVM


def stripped_html(html) -> Column:
    """HTML without comments, scripts and styles, at any depth; an unclosed one ends with the text."""
    return F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\z)", "")


def is_unsafe_url(url) -> Column:
    """Whether a link's scheme runs or embeds content, whatever blanks lead it."""
    return F.coalesce((F.col(url) if isinstance(url, str) else url).rlike(r"(?i)^[\x00-\x20]*(javascript|data|vbscript):"), F.lit(False))


def _cell(c) -> Column:
    return F.translate(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("｜")), "\n", " ")


def rows_to_tables(rows: DataFrame, header: list[str]) -> DataFrame:
    """(sheet, text): a pipe table of each sheet's rows (sheet, row, cells) in order, short rows filled up."""
    width = len(header)
    cells = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: _cell(F.try_element_at("cells", i)))
    line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = rows.select("sheet", "row", line.alias("line")).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("r"))
    head = "| " + " | ".join(header) + " |\n| " + " | ".join(["---"] * width) + " |\n"
    return body.select("sheet", F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("text"))


def walk_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value): the scalar members of objects of one level, in the JVM."""
    members = F.from_json(column, "map<string,string>")
    return rows.select(key, F.explode(members).alias("path", "value"))


def grade(docs: DataFrame) -> DataFrame:
    """(doc_id, structure) of Markdown ``docs`` (doc_id, text), by running sums over lines.

    ``flat-text``: a carriage return, or no heading outside fences; ``structured``: also a table with a real header or a closed
    fence; else ``inferred``.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", F.contains("t", F.lit("\r")).alias("cr"), F.posexplode(F.split("t", "\n", -1)).alias("i", "line"))
    order = Window.partitionBy("doc_id").orderBy("i")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    rows = rows.withColumn("fence", fence).withColumn("next", F.lead("line").over(order))
    rows = rows.withColumn("open", F.sum(F.col("fence").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 1)
    heading = ~F.col("fence") & ~F.col("open") & F.col("line").rlike(r"^#{1,6}\s+")
    table = F.col("line").rlike(r"^\s*\|.*\|\s*$") & F.col("line").rlike(r"[^\s|:—-]") & F.col("next").rlike(r"^\s*\|[\s:|-]+\|\s*$") & F.col("next").contains("-")
    facts = rows.groupBy("doc_id").agg(F.max("cr").alias("cr"), F.max(heading).alias("heading"), F.max(F.coalesce(table, F.lit(False))).alias("table"), F.count_if("fence").alias("fences"))
    verdict = F.when(F.col("cr") | ~F.col("heading"), "flat-text").when(F.col("table") | (F.col("fences") >= 2), "structured").otherwise("inferred")
    return facts.select("doc_id", verdict.alias("structure"))


# Per document


def grade_text(text: str) -> str:
    """The same verdict for one text."""
    if "\r" in text:
        return "flat-text"
    lines, fences, heading, table = text.split("\n"), 0, False, False
    for line, after in zip(lines, [*lines[1:], ""]):
        if re.match(r"\s*(```|~~~)", line):
            fences += 1
        elif fences % 2 == 0 and re.match(r"#{1,6}\s+", line):
            heading = True
        if re.fullmatch(r"\s*\|.*\|\s*", line) and re.search(r"[^\s|:—-]", line) and re.fullmatch(r"\s*\|[\s:|-]+\|\s*", after) and "-" in after:
            table = True
    return "flat-text" if not heading else "structured" if table or fences >= 2 else "inferred"


def cap_bytes(text: str, most: int) -> str:
    """The longest prefix of at most that many UTF-8 bytes."""
    raw = text.encode("utf-8", "replace")
    return text if len(raw) <= most else raw[: max(0, most)].decode("utf-8", "ignore")


class _Markdown(HTMLParser):
    """Collects Markdown blocks from a stream of tags; blocks end where the next one starts, so unclosed tags do no harm."""

    BLOCKS = frozenset("p div section article header footer main nav aside ul ol table form figure blockquote address dl dt dd hr title".split())
    SILENT = frozenset(("script", "style", "head", "template"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.line, self.silent, self.links = [], [], [], []
        self.pre, self.level, self.lists, self.rows, self.cells = None, 0, [], None, None

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.line)).strip()
        self.line = []
        if text:
            if self.level:
                text = "#" * self.level + " " + text
            elif self.lists and self.lists[-1][1]:
                text = "  " * (len(self.lists) - 1) + (f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- ") + text
            self.blocks.append(text)

    def end_cell(self) -> None:
        if self.cells is not None and self.line:
            self.cells.append(re.sub(r"\s+", " ", "".join(self.line)).strip())
            self.line = []

    def end_row(self) -> None:
        self.end_cell()
        if self.cells:
            self.rows.append(self.cells)
        self.cells = None

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent.append(tag)
        elif self.silent and tag not in ("body", "h1", "article"):
            return
        elif tag in ("body", "h1", "article") and self.silent:
            self.silent = []
        at = dict(attrs)
        if self.pre is not None:
            if tag == "code":
                found = re.search(r"language-([\w+-]+)", at.get("class") or "")
                self.pre[0] = found[1] if found else self.pre[0]
        elif tag == "table":
            self.flush()
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.end_row()
            self.cells = []
        elif self.rows is not None and tag in ("td", "th"):
            self.end_cell()
            self.cells = [] if self.cells is None else self.cells
            self.line.append(" ")
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = int(tag[1])
        elif tag == "pre":
            self.flush()
            self.pre = ["", []]
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            if not self.lists:
                self.lists.append(["ul", 0])
            self.lists[-1][1] += 1
        elif tag == "br":
            self.line.append(" " if self.rows is not None else "\n")
        elif tag == "a":
            href = at.get("href") or ""
            self.links.append(None if not href or re.match(r"[\x00-\x20]*(javascript|data|vbscript):", href, re.I) else href)
            self.line.append("[" if self.links[-1] else "")
        elif tag == "img" and not re.match(r"[\x00-\x20]*(javascript|data|vbscript):", at.get("src") or "", re.I):
            self.line.append(f"![{at.get('alt') or ''}]({at.get('src') or ''})")
        elif tag in self.BLOCKS:
            self.level = 0
            self.flush()

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                del self.silent[self.silent.index(tag) :]
            return
        if tag == "pre" and self.pre is not None:
            lang, parts = self.pre
            self.blocks.append(f"```{lang}\n" + "".join(parts).strip("\n") + "\n```")
            self.pre = None
        elif tag == "table" and self.rows is not None:
            self.end_row()
            if self.rows:
                self.blocks.append(pipe_table(self.rows))
            self.rows = None
        elif tag == "tr" and self.rows is not None:
            self.end_row()
        elif tag in ("td", "th") and self.rows is not None:
            self.line = self.line or [""]
            self.end_cell()
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.level = 0
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists = self.lists[:-1]
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.line.append(f"]({href})" if href else "")
        elif tag in self.BLOCKS or tag == "li":
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            (self.pre[1] if self.pre is not None else self.line).append(data)


#: What shows nothing, to its end or the text's; a start never goes past the next one, so that many unclosed ones cost no more than the text's length.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Seconds that a document may take.
SECONDS = 60.0


@contextmanager
def time_limit(seconds: float):
    """Raises a TimeoutError in what takes longer; a timer needs the main thread, which is where a Python worker runs."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(*_):
        raise TimeoutError(f"the document took more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def html_to_markdown(html: str) -> str:
    parser = _Markdown()
    html = _HIDDEN.sub("", re.sub("\r\n?", "\n", html))
    end = html.rfind(">") + 1  # no tag begins behind the last one's end
    parser.feed(html[:end] + html[end:].replace("<", "&lt;"))
    parser.close()
    parser.flush()
    out = []
    for block in parser.blocks:
        listed = re.match(r"\s*(?:- |\d+\. )", block)
        out.append(("\n" if out and listed and re.match(r"\s*(?:- |\d+\. )", out[-1].lstrip("\n")) else "\n\n" if out else "") + block)
    return "".join(out) + ("\n" if out else "")


def pipe_table(rows: list[list], title: str | None = None) -> str:
    """A pipe table whose first row is its header."""
    width = max((len(r) for r in rows), default=0)
    clean = [[("" if c is None else str(c)).replace("|", "｜").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]] for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    body = [line(clean[0]), line(["---"] * width), *map(line, clean[1:])] if clean else []
    return "\n".join(([f"## {title}", ""] if title else []) + body)


def _delimiter(text: str) -> str:
    """The delimiter by which most of the first rows have the same number of cells, more than one; the one with more cells among equals."""
    first = [x for x in text[:65_536].splitlines(keepends=True) if x.strip()][:100]
    best, found = (0, 0), ","
    for d in ",;\t|":
        widths = Counter(len(r) for r in csv.reader(first, delimiter=d))
        width, n = max(widths.items(), key=lambda x: (x[1], x[0]), default=(1, 0))
        if width > 1 and (n, width) > best:
            best, found = (n, width), d
    return found


def csv_to_markdown(text: str, title: str) -> str:
    text = text.removeprefix("﻿")
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=_delimiter(text)) if any(c.strip() for c in r)]
    if not rows:
        raise ValueError("the file has no rows")
    return pipe_table([[c.replace("\r\n", "\n") for c in r] for r in rows], title)


def json_to_markdown(text: str) -> str:
    """A fenced copy of small or invalid JSON, else its members under headings of their paths."""
    if not text.strip():
        raise ValueError("the file is empty")
    try:
        value = json.loads(text)
    except ValueError:
        return f"```\n{text}\n```"
    if len(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()) <= JSON_FENCE_LIMIT:
        return "```json\n" + json.dumps(value, ensure_ascii=False, indent=2) + "\n```"
    out, todo = [], [(value, "", 0)]
    while todo:
        node, path, depth = todo.pop()
        inner = list(node.items()) if isinstance(node, dict) else list(enumerate(node)) if isinstance(node, list) else None
        if depth > JSON_DEPTH:
            out.append(f"## {path}\n\n- (nested too deeply)\n")
        elif inner is None:
            out.append(f"- {path}: {json.dumps(node, ensure_ascii=False)}")
        elif not inner:
            out.append(f"## {path}\n\n- (empty {'object' if isinstance(node, dict) else 'array'})\n")
        else:
            named = isinstance(node, dict)
            if named and path:
                out.append(f"## {path}\n")
            todo += [(child, (f"{path}.{k}" if path else k) if named else f"{path}[{k}]", depth + 1) for k, child in reversed(inner)]
    return "\n".join(out) + "\n"


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def xlsx_to_markdown(data: bytes) -> str:
    """A pipe table of each sheet with more than one row, under the sheet's name."""
    tag = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = [] if (x := _xml(z, "xl/sharedStrings.xml")) is None else ["".join(t.text or "" for t in s.iter() if tag(t) == "t") for s in x]
        links = {r.get("Id"): r.get("Target").lstrip("/") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        parts = []
        for sheet in (e for e in _xml(z, "xl/workbook.xml").iter() if tag(e) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            root, rows = _xml(z, target if target.startswith("xl/") else f"xl/{target}"), []
            for row in (e for e in root.iter() if tag(e) == "row"):
                cells: list[str] = []
                for c in row:
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    raw = "".join(t.text or "" for t in c.iter() if tag(t) in ("v", "t"))
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = strings[int(raw)] if c.get("t") == "s" and raw else raw
                rows.append(cells)
            if len(rows) > 1:
                parts.append(pipe_table(rows, sheet.get("name")) + "\n")
    if not parts:
        raise ValueError("no sheet has rows under a header")
    return "\n".join(parts)


_HEADING_STYLE = re.compile(r"^(?:heading|标题|標題|見出し|见出し)\s*([1-6])$", re.I)


def docx_to_markdown(data: bytes) -> tuple[str, bool]:
    """Headings by outline level or style name, list items, tables and paragraphs; images become their mark.

    The second value tells whether a paragraph has a style that says nothing here, so that a heading may have been lost."""
    tag = lambda e: e.tag.rpartition("}")[2]
    val = lambda e: next((v for k, v in e.attrib.items() if k.endswith("}val")), None)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        levels: dict = {}
        for style in (e for e in (_xml(z, "word/styles.xml") if "word/styles.xml" in z.namelist() else []) if tag(e) == "style"):
            key = next((v for k, v in style.attrib.items() if k.endswith("}styleId")), None)
            name = next((val(e) for e in style if tag(e) == "name"), "") or ""
            outline = next((int(val(e)) for e in style.iter() if tag(e) == "outlineLvl"), None)
            named = _HEADING_STYLE.match(name)
            if outline is not None and outline < 6:
                levels[key] = outline + 1
            elif named:
                levels[key] = int(named[1])
        body = next(e for e in _xml(z, "word/document.xml") if tag(e) == "body")

    def said(p) -> str:
        return "".join({"t": e.text or "", "tab": "\t", "br": "\n", "drawing": IMAGE}.get(tag(e), "") for e in p.iter())

    out, lost = [], False
    for e in body:
        if tag(e) == "tbl":
            rows = [[" ".join(said(p) for p in c.iter() if tag(p) == "p").strip() for c in r if tag(c) == "tc"] for r in e.iter() if tag(r) == "tr"]
            out += [pipe_table(rows)] if rows else []
        elif tag(e) == "p" and (text := said(e).strip()):
            style = next((val(s) for s in e.iter() if tag(s) == "pStyle"), None)
            listed = any(tag(s) == "numPr" for s in e.iter())
            lost |= style is not None and style not in levels and not listed
            out.append("#" * levels[style] + " " + text if style in levels else "- " + text if listed else text)
    if not out:
        raise ValueError("the document has no text")
    return "\n\n".join(out) + "\n", lost


def converted(name: str, data: bytes, limit: int = TEXT_LIMIT) -> tuple:
    """A row of RESULT for one file; whatever goes wrong with it is said in the row."""
    ext = name.rpartition(".")[2].lower()
    stem, lost = re.split(r"[\\/]", name)[-1].rpartition(".")[0], False
    try:
        how = T.FORMATS.get(ext)
        if how in (None, "pdf"):
            return None, None, False, True, f"no converter for .{ext}"
        with time_limit(SECONDS):
            if how == "xlsx":
                text = xlsx_to_markdown(data)
            elif how == "docx":
                text, lost = docx_to_markdown(data)
            else:
                text = data.decode("utf-8", "replace").removeprefix("﻿")
                text = {"html": html_to_markdown, "csv": lambda t: csv_to_markdown(t, stem), "json": json_to_markdown}.get(how, lambda t: t)(text)
        text = re.sub("\r\n?", "\n", text)
        if how != "verbatim" and not text.strip():
            return None, None, False, True, "nothing was left of the document"
    except (ValueError, KeyError, TypeError, StopIteration, AttributeError, TimeoutError, csv.Error, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return None, None, False, True, str(e) or type(e).__name__
    kept = cap_bytes(text, limit)
    grade = grade_text(kept)
    return kept, "inferred" if lost and grade == "structured" else grade, kept != text, False, None


def convert_files(files: DataFrame) -> DataFrame:
    """Files (name, content) with RESULT's columns. Plain text is decoded in the JVM; the rest goes to Python in small batches."""
    how = T.format_of("name")
    plain = files.where(how == "verbatim").select("name", T.ingested(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    plain = plain.select("name", "text", F.lit("unparsed").alias("structure"), F.lit(False).alias("truncated"), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("error"))
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(n, *converted(n, bytes(c))) for n, c in zip(pdf["name"], pdf["content"])]
            yield pd.DataFrame(rows, columns=["name", *names])

    from lorespark.operators.pdf import convert_pdfs

    other = files.where(~F.coalesce(how.isin("verbatim", "pdf"), F.lit(False))).select("name", "content").transform(bounded).mapInPandas(run, f"name string, {RESULT}")
    return plain.unionByName(other).unionByName(convert_pdfs(files))


def convert_html(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, text, structure) of a column of HTML; both are null for a page that takes longer than SECONDS."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            text = [_in_time(h) for h in pdf["_html"]]
            yield pd.DataFrame({"_key": pdf["_key"], "text": text, "structure": [None if t is None else grade_text(t) for t in text]})

    #: Keys go as text: pandas would turn whole numbers beside a null into doubles.
    out = rows.select(F.col(key).cast("string").alias("_key"), F.col(column).alias("_html")).transform(bounded).mapInPandas(run, "_key string, text string, structure string")
    return out.select(F.col("_key").cast(kind).alias(key), "text", "structure")


def _in_time(html: str | None) -> str | None:
    try:
        with time_limit(SECONDS):
            return html_to_markdown(html or "")
    except TimeoutError:
        return None
