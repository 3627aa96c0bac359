"""Token-budgeted chunking.

A document is cut into pieces that respect its structure (``heading``, ``paragraph`` or ``fixed``), pieces into windows of at most
``chunk_tokens``. Cutting is sequential within a document, so a small function runs per document inside an Arrow stage,
with no shuffle; everything over its chunks (ordinals' totals, overlaps, previews, ids) is DataFrame work.

Offsets are code points of the newline-normalized text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lorespark.functions.batches import bounded
from lorespark.functions import text as T

MODES = ("heading", "paragraph", "fixed")
#: Characters of chunks that a task gives at once.
OUT = 1 << 20
CHUNK = "ordinal int, text string, tokens long, char_start long, char_end long, overlap_tokens long, heading string"

_WIDE = T.wide_pattern()
_FENCE = re.compile(r"\s*(?:```|~~~)")
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
#: Lines that may be fences or headings.
_MARKED = re.compile(r"^(?:#|[^\S\n]*(?:```|~~~)).*", re.M)
_PARAGRAPH = re.compile(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*")
_CODE = re.compile(r"^(?:```[^\n]*\n.*?(?:\n```|\Z)|~~~[^\n]*\n.*?(?:\n~~~|\Z))", re.S | re.M)
_ROW = re.compile(r"\s*\|.*\|\s*\Z")
_RULE = re.compile(r"\s*\|[\s:|-]*-[\s:|-]*\|\s*\Z")
_ENDS = ("\n\n", "。", ".")


@dataclass(frozen=True)
class Config:
    mode: str = "heading"
    chunk_tokens: int = 1024
    overlap_tokens: int = 128
    min_chunk_tokens: int = 64
    preserve_code_blocks: bool = True
    split_tables_by_row: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if self.chunk_tokens < 1 or not 0 <= self.overlap_tokens < self.chunk_tokens or not 0 <= self.min_chunk_tokens <= self.chunk_tokens:
            raise ValueError("overlap must be less than, and the minimum at most, the chunk's tokens")


def _plain(text: str) -> bool:
    """Whether a text holds no wide character, as most do."""
    return text.isascii() or not _WIDE.search(text)


def tokens_of(text: str, plain: bool = False) -> int:
    wide = 0 if plain else len(_WIDE.findall(text))
    return wide + -(-(len(text) - wide) // 4)


class _Measure:
    """Token counts of any slice of one text from running sums of its wide characters."""

    def __init__(self, text: str, plain: bool = False):
        self.wide = None if plain or _plain(text) else [0, *accumulate(map(bool, map(_WIDE.match, text)))]
        self.size = len(text)

    def tokens(self, start: int, end: int) -> int:
        wide = self.wide[end] - self.wide[start] if self.wide else 0
        return wide + -(-(end - start - wide) // 4)

    def furthest(self, start: int, budget: int) -> int:
        """The largest end whose slice from ``start`` fits the budget."""
        if not self.wide:
            return min(self.size, start + 4 * budget)
        ends = range(start, min(self.size, start + 4 * budget) + 1)
        return start + bisect_right(ends, budget, key=lambda e: self.tokens(start, e)) - 1

    def back(self, end: int, wanted: int) -> int:
        """The nearest start from which the slice up to ``end`` has the wanted tokens (0 if none has)."""
        if not self.wide:
            return max(0, end - 4 * (wanted - 1) - 1)
        starts = range(end - 1, -1, -1)
        found = bisect_right(starts, wanted - 1, key=lambda s: self.tokens(s, end))
        return starts[found] if found < len(starts) else 0


def _sections(text: str):
    """(start, text, heading path) of each section: a heading opens one, whatever body it has."""
    path, opened, start, fenced = [], False, 0, False
    for m in _MARKED.finditer(text):
        at, line = m.start(), m[0]
        fenced ^= bool(_FENCE.match(line))
        found = None if fenced else _HEADING.fullmatch(line)
        if found:
            if at and (opened or text[start : at - 1].strip()):
                yield start, text[start : at - 1], " › ".join(t for _, t in path) or None
            level = len(found[1])
            path = [p for p in path if p[0] < level] + [(level, found[2].strip())]
            opened, start = True, at
    if opened or text[start:].strip():
        yield start, text[start:], " › ".join(t for _, t in path) or None


def _segments(text: str, mode: str):
    if mode == "heading":
        yield from _sections(text)
    elif mode == "paragraph":
        yield from ((m.start(), m[0], None) for m in _PARAGRAPH.finditer(text) if m[0].strip())
    elif text.strip():
        yield 0, text, None


def _windows(text: str, budget: int, overlap: int, plain: bool = False):
    """(start, text) of windows within the budget, cut after a paragraph or sentence in their second half where there is one."""
    m, start = _Measure(text, plain), 0
    while start < len(text):
        end = cut = max(m.furthest(start, budget), start + 1)
        if end < len(text):
            stop = max(text.rfind(e, start, end) for e in _ENDS)
            if stop - start > (end - start) / 2:
                cut = stop + 1
        yield start, text[start:cut]
        if cut >= len(text):
            return
        start = max(m.back(cut, overlap) if overlap else cut, start + 1)


def _table_windows(text: str, budget: int):
    """Windows of whole rows under a repeated header, where a table is over the budget; None where none is."""
    lines = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    tables, i = [], 1
    while i < len(lines):
        if _RULE.match(lines[i]) and _ROW.match(lines[i - 1]):
            end = next((j for j in range(i + 1, len(lines)) if not _ROW.match(lines[j])), len(lines))
            if tokens_of("\n".join(lines[i - 1 : end])) > budget:
                tables.append((i - 1, end))
            i = end
        i += 1
    if not tables:
        return None
    out, done = [], 0
    for first, end in [*tables, (len(lines), len(lines))]:
        prose = "\n".join(lines[done:first])
        if prose.strip():
            out += [(starts[done] + s, w) for s, w in ([(0, prose)] if tokens_of(prose) <= budget else _windows(prose, budget, 0))]
        head, row = "\n".join(lines[first : first + 2]), first + 2
        while row < end:
            last, used = row, tokens_of(head)
            while last < end and (last == row or used + tokens_of("\n" + lines[last]) <= budget):
                used += tokens_of("\n" + lines[last])
                last += 1
            out.append((starts[row], head + "\n" + "\n".join(lines[row:last])))
            row = last
        done = end
    return [x for x in out if x[1].strip()]


def _sized(text: str, c: Config, plain: bool):
    """(start, text, heading) of pieces within the budget, before the minimum is applied."""
    for start, body, heading in _segments(text, c.mode):
        cuts = [(m.start(), m.end()) for m in _CODE.finditer(body)] if c.preserve_code_blocks and ("```" in body or "~~~" in body) else []
        edges = sorted({0, len(body), *(e for cut in cuts for e in cut)})
        for a, b in zip(edges, edges[1:]):
            piece, code = body[a:b], (a, b) in cuts
            if tokens_of(piece, plain) <= c.chunk_tokens:
                parts = [(0, piece)]
            else:
                parts = (_table_windows(piece, c.chunk_tokens) if c.split_tables_by_row else None) or _windows(piece, c.chunk_tokens, 0 if code else c.overlap_tokens, plain)
            yield from ((start + a + s, w, heading) for s, w in parts)


def _only_headings(text: str) -> bool:
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return bool(lines) and all(re.match(r"#{1,6}\s+\S|#{1,6}\s*\Z", x) for x in lines)


def chunks_of(text: str, c: Config) -> tuple[list[tuple], int]:
    """Rows of CHUNK for one document, and how many pieces were too small to keep.

    Small pieces that hold only headings wait for the next kept piece and lead it; at the end they stand for themselves.
    """
    text = re.sub("\r\n?", "\n", text)
    rows, waiting, dropped, plain = [], [], 0, _plain(text)
    for start, body, heading in _sized(text, c, plain):
        end = start + len(body)
        if tokens_of(body, plain) < c.min_chunk_tokens:
            if _only_headings(body):
                waiting.append((start, end, body, heading))
            else:
                dropped += 1
            continue
        if waiting:
            body = "\n".join(w[2].strip() for w in waiting) + "\n\n" + body
            start = min(start, waiting[0][0])
            waiting = []
        rows.append((start, end, body, heading))
    rows += waiting
    out, before = [], 0
    for i, (start, end, body, heading) in enumerate(rows):
        shared = max(0, before - start) if i else 0
        out.append((i, body, tokens_of(body, plain), start, end, tokens_of(body[:shared], plain) if shared else 0, heading))
        before = end
    return out, dropped


def chunk_documents(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, chunk_id, ordinal, text, tokens, char_start, char_end, overlap_tokens, heading, discarded) of each chunk of
    ``docs`` (doc_id, text); ``discarded`` is the document's. A document without chunks gives no rows; null texts count as empty, and
    a null doc_id stays null beside any other."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id string, {CHUNK}, discarded long")

    def run(batches):
        import pyarrow as pa

        kind = to_arrow_schema(schema)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)
        #: Texts leave as soon as some are cut: what is held is a batch, a document's chunks and OUT characters.
        out, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                doc, (rows, dropped) = doc.as_py(), chunks_of(text.as_py() or "", config)
                for row in rows:
                    out.append((doc, *row, dropped))
                    size += len(row[1])
                    if size >= OUT:
                        yield made(out)
                        out, size = [], 0
        if out:
            yield made(out)

    rows = docs.select(F.col("doc_id").cast("string"), "text").transform(bounded).mapInArrow(run, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast(doc_type)).withColumn("chunk_id", F.concat_ws("#", F.col("doc_id").cast("string"), "ordinal"))


def plan_totals(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunks, discarded, tokens, average_tokens, overlap_tokens) for each document and, under a null doc_id, for all."""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max("discarded").alias("discarded"), F.sum("tokens").alias("tokens"), F.sum("overlap_tokens").alias("overlap_tokens"))
    sums = [F.sum(c).cast("long").alias(c) for c in ("chunks", "discarded", "tokens", "overlap_tokens")]
    both = per.rollup("doc_id").agg(*sums)
    return both.withColumn("average_tokens", F.floor(F.col("tokens") / F.col("chunks") + 0.5).cast("long"))


def preview(chunks: DataFrame, n: int = 5) -> DataFrame:
    """The first n chunks of each document."""
    return chunks.where(F.col("ordinal") < n)


def overlaps(chunks: DataFrame) -> DataFrame:
    """Overlap of each chunk (doc_id, ordinal, char_start, char_end) with its predecessor, in characters."""
    before = F.lag("char_end").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return chunks.withColumn("overlap_chars", F.greatest(F.coalesce(before - F.col("char_start"), F.lit(0)), F.lit(0)).cast("long"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, text, tokens): paragraphs without offsets, in the JVM alone."""
    found = F.regexp_extract_all(T.normalize_newlines("text"), F.lit(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*"), 0)
    kept = F.filter(found, lambda p: p.rlike(r"\S"))
    return docs.select("doc_id", F.posexplode(kept).alias("ordinal", "text")).withColumn("tokens", T.token_estimate("text"))


def register_chunk_function(spark, name: str = "chunk") -> None:
    """A table function for SQL: ``SELECT d.doc_id, c.* FROM docs d, LATERAL chunk(d.text, 'heading', 512, 64, 1) c``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=CHUNK)
    class Chunk:
        def eval(self, text: str, mode: str, chunk_tokens: int, overlap_tokens: int, min_chunk_tokens: int):
            yield from chunks_of(text or "", Config(mode, chunk_tokens, overlap_tokens, min_chunk_tokens))[0]

    spark.udtf.register(name, Chunk)
