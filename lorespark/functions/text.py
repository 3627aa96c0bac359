"""Column functions over text: tokens, newlines, names, scores, citations. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocks whose characters count as a token each (fixed values): kana, ideographs and their extensions, full-width forms.
WIDE = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2EBEF}"

#: How an upload's extension is read (fixed values): as it is, or by a converter.
FORMATS = {
    "md": "verbatim", "markdown": "verbatim", "txt": "verbatim", "pdf": "pdf", "html": "html", "htm": "html",
    "docx": "docx", "xlsx": "xlsx", "csv": "csv", "json": "json",
}

#: Score bands and the least score of each (fixed values).
BANDS = (("strong", 0.85), ("relevant", 0.70), ("fair", 0.55))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wide_pattern() -> re.Pattern:
    """One character of WIDE, for Python."""
    return re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), WIDE) + "]")


def token_estimate(text) -> Column:
    """Wide characters, plus a quarter of all others rounded up."""
    text = _col(text)
    wide = F.length(F.regexp_replace(text, f"[^{WIDE}]", ""))
    return (wide + F.ceil((F.length(text) - wide) / 4)).cast("long")


def normalize_newlines(text) -> Column:
    return F.regexp_replace(_col(text), "\r\n?", "\n")


def ingested(text) -> Column:
    """A text as the store keeps it: without a byte-order mark, lines ended by ``\\n``."""
    return normalize_newlines(F.regexp_replace(_col(text), r"^\x{FEFF}", ""))


def search_tokens(text) -> Column:
    """Lower-cased words; a word that holds wide characters gives its overlapping pairs instead."""
    words = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), 0)
    pairs = lambda w: F.when(F.length(w) < 2, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2))))
    split = F.flatten(F.transform(words, lambda w: F.when(w.rlike(f"[{WIDE}]"), pairs(w)).otherwise(F.array(w))))
    return F.when(_col(text).rlike(f"[{WIDE}]"), split).otherwise(words)


def extension(name) -> Column:
    """The lower-cased extension of a path's last part; empty without one, or where the dot leads or ends it."""
    base = F.regexp_extract(_col(name), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"[^.].*\.([^.]+)$|^[^.]\.([^.]+)$", 1))


def format_of(name) -> Column:
    """The way a file is read, or ``unsupported``."""
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return F.coalesce(F.element_at(known, extension(name)), F.lit("unsupported"))


def match_score(distance) -> Column:
    """1 - distance within 0..1; a distance that is null or not finite scores 0."""
    d = _col(distance)
    odd = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d)))


def confidence_band(score) -> Column:
    out = F.lit("low")
    for name, least in reversed(BANDS):
        out = F.when(_col(score) >= least, name).otherwise(out)
    return out


def dot(a, b) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine similarity of two arrays of doubles, null where a norm is 0; norms that are known needn't be taken for each pair."""
    both = (norm(a) if norm_a is None else _col(norm_a)) * (norm(b) if norm_b is None else _col(norm_b))
    return F.when(both > 0, dot(a, b) / both)


def equals_filter(column: str, value: str) -> str:
    """A filter in SQL for a column that equals a text, whatever quotes and backslashes the text holds."""
    quoted = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"`{column.replace('`', '``')}` = '{quoted}'"


def is_blank(text) -> Column:
    """Whether a text is missing or holds nothing but white space."""
    return ~F.coalesce(_col(text).rlike(r"\S"), F.lit(False))


def line_of(text, offset) -> Column:
    """The number, from 1, of the line that a code-point offset is on."""
    head = F.substring(_col(text), F.lit(1), _col(offset).cast("int"))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def preview(text, chars: int) -> Column:
    """The first characters with white space runs as single spaces."""
    return F.substring(F.trim(F.regexp_replace(_col(text), r"\s+", " ")), 1, chars)


def format_bytes(n) -> Column:
    """B to TB in steps of 1024, with one decimal below ten, halves rounded up; nothing, less and what isn't a number are ``0 B``."""
    n, out = _col(n).cast("double"), None
    for i, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        value = n / 1024.0**i
        tenths = F.floor(value * 10 + 0.5).cast("long")
        short = F.concat((F.floor(tenths / 10)).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
        shown = F.concat(F.when((value < 10) & F.lit(i > 0), short).otherwise(F.floor(value + 0.5).cast("long").cast("string")), F.lit(" " + unit))
        out = shown if out is None else F.when(n < 1024.0 ** (i + 1), shown).otherwise(out)
    return F.when((n <= 0) | F.isnan(n) | (n == float("inf")), "0 B").otherwise(out)


def fnv1a_id(name, seed) -> Column:
    """``doc_`` and eight hex digits: 32-bit FNV-1a over the UTF-16 units of ``name``, a zero and ``seed``."""
    units = F.hex(F.encode(F.concat(_col(name), F.lit("\0"), _col(seed)), "UTF-16BE"))
    codes = F.transform(F.regexp_extract_all(units, F.lit("[0-9A-F]{4}"), 0), lambda u: F.conv(u, 16, 10).cast("long"))
    prime = 16777619
    folded = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, u: F.pmod(h.bitwiseXOR(u) * F.lit(prime), F.lit(2**32)))
    return F.concat(F.lit("doc_"), F.lower(F.lpad(F.hex(folded), 8, "0")))


def collection_domain(name) -> Column:
    """Up to 16 lower-case letters and digits; ``k`` leads a digit, ``kb`` stands for nothing."""
    word = F.substring(F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]", ""), 1, 16)
    led = F.substring(F.when(word.rlike("^[0-9]"), F.concat(F.lit("k"), word)).otherwise(word), 1, 16)
    return F.when(led == "", "kb").otherwise(led)


def collection_id(name) -> Column:
    """``kb_<domain>_<four hex digits>`` with the digits from the name's hash."""
    return F.concat(F.lit("kb_"), collection_domain(name), F.lit("_"), F.substring(fnv1a_id(name, F.lit("")), 5, 4))


def is_collection_id(value) -> Column:
    return _col(value).rlike("^kb_[a-z][a-z0-9]{0,15}_[0-9a-f]{4}$")


def citation_address(collection, doc, line) -> Column:
    """``kb://collection/doc#Lline`` with percent-encoded parts."""
    part = lambda c: F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("kb://"), part(collection), F.lit("/"), part(doc), F.lit("#L"), _col(line).cast("string"))


def parsed_citation(address) -> Column:
    """Struct (collection, doc, line) of an address; null where it isn't one."""
    shape = r"^kb://([^/#]+)/([^/#]+)#L([1-9][0-9]{0,8})$"
    part = lambda i: F.try_url_decode(F.regexp_extract(_col(address), shape, i))
    fit = _col(address).rlike(shape) & part(1).isNotNull() & part(2).isNotNull()
    return F.when(fit, F.struct(part(1).alias("collection"), part(2).alias("doc"), F.regexp_extract(_col(address), shape, 3).cast("int").alias("line")))


def endpoint(url) -> Column:
    """The embeddings endpoint of a base address: trailing slashes go, the path is added once."""
    base = F.regexp_replace(F.trim(_col(url)), "/+$", "")
    return F.when(base.endswith("/embeddings"), base).otherwise(F.concat(base, F.lit("/embeddings")))


def doc_id_of(path) -> Column:
    """The document id that a source path's file stem is; empty where the stem isn't one."""
    stem = F.regexp_replace(F.regexp_extract(_col(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.when(stem.startswith("doc_"), stem).otherwise(F.lit(""))


def relative_path(root, path) -> Column:
    """A path below ``root`` without it, parts joined by slashes; any other path as it is."""
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    base = F.concat(F.regexp_replace(slashed(_col(root)), "/+$", ""), F.lit("/"))
    return F.when(slashed(_col(path)).startswith(base), F.substring(slashed(_col(path)), F.length(base) + 1, F.length(_col(path)))).otherwise(_col(path))


def stamp(iso) -> Column:
    """``YYYY-MM-DD HH:MM`` of an ISO stamp, a dash for none."""
    shown = F.replace(F.substring(_col(iso), 1, 16), F.lit("T"), F.lit(" "))
    return F.when(F.coalesce(_col(iso), F.lit("")) == "", "—").otherwise(shown)


#: What a store says of itself, and what to do about it (the phrases are fixed values).
BUILD_ERRORS = (
    ("collection is closed", "the index was closed by a build that was stopped; submit the build again"),
    ("can't lock", "the index is in use by another build; try again shortly"),
)


def build_error(message) -> Column:
    """A failure's text; what to do about it, where the store's own words don't say."""
    out = _col(message)
    for phrase, advice in BUILD_ERRORS:
        out = F.when(F.contains(F.lower(_col(message)), F.lit(phrase)), F.lit(advice)).otherwise(out)
    return out


def is_wide(text) -> Column:
    """Whether a text holds a character that counts as a token of its own."""
    return F.coalesce(_col(text).rlike(f"[{WIDE}]"), F.lit(False))


def hit_line(rank, band, score, name, line, start, end, text) -> Column:
    """A hit as one numbered line: band and score, place, character range, 300 characters of text."""
    place = F.format_string("%d. [%s %.2f] %s:%d (chars %d-%d) ", _col(rank), _col(band), _col(score), _col(name), _col(line), _col(start), _col(end))
    return F.concat(place, preview(text, 300))


def parsed_hits(text) -> Column:
    """Array of structs (rank, band, score, name, line, char_start, char_end, doc_id) of the lines that ``hit_line`` made."""
    shape = r"(?m)^([0-9]+)\. \[([a-z]+) ([0-9.]+)\] (.*?):([0-9]+) \(chars ([0-9]+)-([0-9]+)\) "
    found = F.regexp_extract_all(_col(text), F.lit(shape), 0)
    part = lambda x, i: F.regexp_extract(x, shape, i)
    return F.transform(found, lambda x: F.struct(
        part(x, 1).cast("int").alias("rank"), part(x, 2).alias("band"), part(x, 3).cast("double").alias("score"), part(x, 4).alias("name"),
        part(x, 5).cast("int").alias("line"), part(x, 6).cast("int").alias("char_start"), part(x, 7).cast("int").alias("char_end"), doc_id_of(part(x, 4)).alias("doc_id"),
    ))
