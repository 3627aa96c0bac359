"""Text-layer PDF files to Markdown.

``runs_of`` reads positioned text from a file's content streams (Flate or plain, simple fonts, ToUnicode maps); scans and encrypted files are refused
with what to do about them. A file that tags its text is laid out by its tags; else layout is inferred from geometry: lines, columns, headings by
size, tables by aligned cells. What is inferred is never graded ``structured``.
"""

from __future__ import annotations

import re
import time
import zlib
from collections import Counter
from itertools import groupby
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.batches import bounded
from lorespark.functions import text as T
from lorespark.operators.convert import RESULT, TEXT_LIMIT, cap_bytes, grade_text, pipe_table

#: Limits and thresholds of the layout (fixed values): pages and seconds; sizes that make headings, and their most characters; a table's
#: rows; steps of a size in a point; what joins a line and parts a paragraph, in sizes.
PAGES, SECONDS = 1000, 120.0
HEADING_SIZES, HEADING_CHARS = 6, 40
TABLE_ROWS = (3, 200)
SIZE_STEPS, SAME_LINE, NEW_PARAGRAPH = 4, 0.5, 1.8
#: Tags of marked content that lay out a page (fixed values).
HEADING_TAGS = {"H": 1, "H1": 1, "H2": 2, "H3": 3, "H4": 4, "H5": 5, "H6": 6}
TABLE_TAGS = frozenset(("Table", "TR", "TH", "TD"))
BLOCK_TAGS = frozenset((*HEADING_TAGS, *TABLE_TAGS, "P", "L", "LI", "LBody"))


class Run(NamedTuple):
    page: int
    x: float
    y: float
    width: float
    size: float
    text: str
    tag: str = ""


class Refused(ValueError):
    """A file that can't be read as text; says what would help."""


_WIDE = re.compile("[\u2e80-\uffef]")
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _refs(body: bytes, key: bytes) -> list[int]:
    found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", found[1])] if found else []


def _stream(body: bytes) -> bytes:
    m = _STREAM.match(body)
    if not m:
        return b""
    if b"FlateDecode" in m[1]:
        try:
            return zlib.decompressobj().decompress(m[2])
        except zlib.error:
            return b""
    return b"" if b"/Filter" in m[1] else m[2]


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        h = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())

    def unescaped(m):
        return bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])

    return re.sub(rb"\\([0-7]{1,3}|.)", unescaped, token[1:-1], flags=re.S)


def _to_unicode(cmap: bytes) -> dict[bytes, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for i in range(min(int(b, 16) - int(a, 16) + 1, 65_536)):
                out[(int(a, 16) + i).to_bytes(len(a) // 2, "big")] = chr(int(c, 16) + i)
    return out


def _decoded(raw: bytes, cmap: dict[bytes, str]) -> str:
    if not cmap:
        return raw.decode("utf-16-be", "ignore") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    n = len(next(iter(cmap)))
    return "".join(cmap.get(raw[i : i + n], "") for i in range(0, len(raw), n))


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body[:400] and (inner := _stream(body)):
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            places = list(map(int, inner[:first].split()))
            ends = [*places[3::2], len(inner) - first]
            for number, start, end in zip(places[::2], places[1::2], ends):
                found.setdefault(number, inner[first + start : first + end])
    return found


def _page_runs(page: int, content: bytes, fonts: dict[bytes, dict]) -> list[Run]:
    runs, stack, font, size, lead, marks = [], [], {}, 0.0, 0.0, []
    line = at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

    def move(x, y):
        a, b, c, d, e, f = line
        return a, b, c, d, x * a + y * c + e, x * b + y * d + f

    def show(raw):
        nonlocal at
        text, scale = _decoded(raw, font), (at[2] ** 2 + at[3] ** 2) ** 0.5 * size
        width = sum(1.0 if _WIDE.match(ch) else 0.5 for ch in text) * scale
        if text.strip():
            runs.append(Run(page, at[4], at[5], width, scale, text, next((x for x in reversed(marks) if x != "Document"), "")))
        at = (*at[:4], at[4] + width, at[5])

    for m in _TOKEN.finditer(content):
        t = m[0]
        if not re.fullmatch(rb"[A-Za-z'\"*]+", t):
            stack.append(t)
            continue
        number = lambda i: float(stack[i])
        try:
            if t == b"BT":
                line = at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif t == b"Tf":
                font, size = fonts.get(stack[-2][1:], {}), number(-1)
            elif t in (b"BMC", b"BDC"):
                marks.append(stack[0][1:].decode("latin-1") if stack else "")
            elif t == b"EMC":
                del marks[-1:]
            elif t == b"TL":
                lead = number(-1)
            elif t in (b"Td", b"TD"):
                lead = -number(-1) if t == b"TD" else lead
                line = at = move(number(-2), number(-1))
            elif t == b"Tm":
                line = at = tuple(map(float, stack[-6:]))
            elif t == b"T*":
                line = at = move(0.0, -lead)
            elif t in (b"'", b'"'):
                line = at = move(0.0, -lead)
                show(_string(stack[-1]))
            elif t == b"Tj":
                show(_string(stack[-1]))
            elif t == b"TJ":
                parts = stack[len(stack) - stack[::-1].index(b"[") :] if b"[" in stack else []
                for x in parts:
                    if x[:1] in b"(<":
                        show(_string(x))
                    elif x != b"]":
                        at = (*at[:4], at[4] - float(x) / 1000 * size * at[0], at[5])
        except (IndexError, ValueError):
            pass  # an operator without its operands draws nothing
        stack = []
    return runs


def runs_of(data: bytes, pages: int = PAGES, seconds: float = SECONDS) -> tuple[list[Run], bool]:
    """Runs of text in the order they're drawn, and whether a limit cut them short."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise Refused("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise Refused("the file is encrypted; save it without a password")
    objects, until = _objects(data), time.monotonic() + seconds
    sheets = [n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    if not sheets:
        raise Refused("the file has no pages that can be read")
    order: list[int] = []
    todo = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
    while todo:
        n = todo.pop()
        kids = _refs(objects.get(n, b""), b"Kids")
        order += [n] if n in sheets else []
        todo += reversed(kids)
    runs: list[Run] = []
    for i, n in enumerate(order or sheets):
        if i >= pages or time.monotonic() > until:
            return runs, True
        body = objects[n]
        resources = objects.get((_refs(body, b"Resources") or [-1])[0], body)
        listed = re.search(rb"/Font\s*<<(.*?)>>", resources, re.S) or re.search(rb"<<(.*?)>>", objects.get((_refs(resources, b"Font") or [-1])[0], b""), re.S)
        fonts = {}
        for name, ref in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", listed[1]) if listed else []:
            cmap = _refs(objects.get(int(ref), b""), b"ToUnicode")
            fonts[name] = _to_unicode(_stream(objects.get(cmap[0], b""))) if cmap else {}
        content = b"\n".join(_stream(objects.get(c, b"")) for c in _refs(body, b"Contents"))
        runs += _page_runs(i + 1, content, fonts)
    return runs, False


def lines_of(runs: list[Run]) -> list[list[Run]]:
    """Runs of one page as lines, top down, left to right; a run joins a line while it's within half a size of the line's first."""
    out: list[list[Run]] = []
    for r in sorted(runs, key=lambda r: (-r.y, r.x)):
        if out and abs(out[-1][0].y - r.y) <= max(0.5, min(out[-1][0].size, r.size) * SAME_LINE):
            out[-1].append(r)
        else:
            out.append([r])
    return [sorted(x, key=lambda r: r.x) for x in out]


def body_size(runs: list[Run]) -> float:
    """The size of most characters, in quarter points."""
    seen: Counter = Counter()
    for r in runs:
        seen[round(r.size * SIZE_STEPS) / SIZE_STEPS] += len(r.text.strip())
    return min((s for s, n in seen.items() if n == max(seen.values())), default=0.0)


def columns_of(lines: list[list[Run]]) -> list[list[list[Run]]]:
    """Lines as one column, or as two where every line of several runs leaves the same gutter."""
    gutters = [[(a.x + a.width, b.x) for a, b in zip(x, x[1:]) if b.x - a.x - a.width > 2 * a.size] for x in lines if len(x) > 1]
    if len(gutters) < 3 or any(len(g) != 1 for g in gutters):
        return [lines]
    edge = [g[0][1] for g in gutters]
    if max(edge) - min(edge) > 8:
        return [lines]
    at = min(edge) - 4
    left = [[r for r in x if r.x < at] for x in lines]
    right = [[r for r in x if r.x >= at] for x in lines]
    return [[x for x in side if x] for side in (left, right)]


def line_text(line: list[Run]) -> str:
    """A line's text: no space between wide characters, a tab in a wide gap."""
    out = line[0].text
    for a, b in zip(line, line[1:]):
        gap = b.x - a.x - a.width
        wide = bool(_WIDE.match(a.text[-1:])) and bool(_WIDE.match(b.text))
        out += ("\t" if gap > 2 * a.size else "" if wide or gap < 0.15 * a.size or out.endswith(" ") or b.text.startswith(" ") else " ") + b.text
    return out.strip()


def _cells(line: list[Run]) -> list[tuple[float, str]]:
    cells: list[tuple[float, list[Run]]] = []
    for r in line:
        if cells and r.x - cells[-1][1][-1].x - cells[-1][1][-1].width <= r.size:
            cells[-1][1].append(r)
        else:
            cells.append((r.x, [r]))
    return [(x, line_text(rs)) for x, rs in cells]


def _table(lines: list[list[Run]], at: int) -> int:
    """How many lines from ``at`` make a table: the same number of cells, each under the header's."""
    head, n = _cells(lines[at]), 1
    if len(head) < 2:
        return 0
    near = max(3.0, lines[at][0].size / 2)
    while at + n < len(lines) and n < TABLE_ROWS[1]:
        row = _cells(lines[at + n])
        if len(row) != len(head) or any(abs(a - b) > near for (a, _), (b, _) in zip(row, head)):
            break
        n += 1
    return n if n >= TABLE_ROWS[0] else 0


def _tagged(runs: list[Run]) -> str:
    """Blocks as the file's own tags tell them: headings by level, lines of table cells as tables, paragraphs."""
    blocks: list[str] = []
    for page in sorted({r.page for r in runs}):
        kinds = []
        for line in lines_of([r for r in runs if r.page == page]):
            tag = next((r.tag for r in line if r.tag in BLOCK_TAGS), "")
            kinds.append(("heading" if tag in HEADING_TAGS else "table" if tag in TABLE_TAGS else "text", tag, line))
        for kind, group in groupby(kinds, key=lambda x: x[0]):
            lines = [(tag, line) for _, tag, line in group]
            if kind == "heading":
                blocks += ["#" * HEADING_TAGS[tag] + " " + line_text(line) for tag, line in lines]
            elif kind == "table":
                blocks.append(pipe_table([[c for _, c in _cells(line)] for _, line in lines]))
            else:
                blocks.append("\n".join(line_text(line) for _, line in lines))
    return "\n\n".join(blocks) + ("\n" if blocks else "")


def is_tagged(runs: list[Run]) -> bool:
    return any(r.tag in BLOCK_TAGS for r in runs)


def pdf_to_markdown(runs: list[Run]) -> str:
    if is_tagged(runs):
        return _tagged(runs)
    body, blocks = body_size(runs), []
    sizes = sorted({round(r.size * SIZE_STEPS) / SIZE_STEPS for r in runs if r.size > body + 0.5}, reverse=True)[:HEADING_SIZES]
    for page in sorted({r.page for r in runs}):
        lines = lines_of([r for r in runs if r.page == page])
        tables = any(_table(lines, i) for i in range(len(lines)))
        for column in [lines] if tables else columns_of(lines):
            i, paragraph = 0, []
            while i < len(column):
                n, text = _table(column, i), line_text(column[i])
                size = round(max(r.size for r in column[i]) * SIZE_STEPS) / SIZE_STEPS
                heading = size in sizes and len(text) <= HEADING_CHARS
                apart = bool(paragraph) and column[i - 1][0].y - column[i][0].y > NEW_PARAGRAPH * column[i][0].size
                if paragraph and (n or heading or apart):
                    blocks.append("\n".join(paragraph))
                    paragraph = []
                if n:
                    blocks.append(pipe_table([[c for _, c in _cells(x)] for x in column[i : i + n]]))
                elif heading:
                    blocks.append("#" * (sizes.index(size) + 1) + " " + text)
                elif text:
                    paragraph.append(text)
                i += n or 1
            if paragraph:
                blocks.append("\n".join(paragraph))
    return "\n\n".join(blocks) + ("\n" if blocks else "")


def preflight(data: bytes) -> str | None:
    """None for a file with text on its first two pages, else what's wrong and what would help."""
    try:
        runs, _ = runs_of(data, pages=2)
    except Refused as e:
        return str(e)
    return None if runs else "no text on the first pages; the file may be a scan, so recognise its text first"


def converted_pdf(data: bytes) -> tuple:
    try:
        runs, cut = runs_of(data)
    except (Refused, ValueError, TypeError, KeyError) as e:
        return None, None, False, True, str(e) or type(e).__name__
    text = pdf_to_markdown(runs)
    if not text.strip():
        return None, None, cut, True, "no text was found; the file may be a scan, so recognise its text first"
    kept = cap_bytes(text, TEXT_LIMIT)
    level = grade_text(kept)
    return kept, "inferred" if level == "structured" and not is_tagged(runs) else level, cut or kept != text, cut, "a limit cut the document short" if cut else None


def convert_pdfs(files: DataFrame) -> DataFrame:
    """Files (name, content) of the extension pdf with RESULT's columns."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(n, *converted_pdf(bytes(c))) for n, c in zip(pdf["name"], pdf["content"])], columns=["name", *names])

    return files.where(F.coalesce(T.format_of("name") == "pdf", F.lit(False))).select("name", "content").transform(bounded).mapInPandas(run, f"name string, {RESULT}")
