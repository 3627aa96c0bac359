"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base patterns (email, ip, card, phone) give seed spans, and so do values that are keys by their shape (SECRET_SEED), of a kind of their own,
``secret``. What stands beside a span is its lexical patterns: one to three words before it, one or two behind it, and a word on
both sides, digits taken as one. Spark keeps the graph of patterns and instances (distinct values) and scores it in ROUNDS rounds: a pattern is as
sure of a kind as the share of its instances that are known to be of it, where unknown ones weigh less than known ones; an instance that
isn't known takes the noisy-or of the surest pattern before it, behind it and on both sides; and instances that are sure enough, seen beside sure patterns and of a shape that the kind allows, are
discovered spans, which also make further patterns sure. Base spans always stay; a key that is a seed is a span wherever it stands.

Null and empty texts have no spans. Repeated rows are searched each. Spans are offsets in code points, end exclusive.
An added span never overlaps a base span of its text. Texts are searched whole, at any length. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, files_like, stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, listed after the others.
ADDED = ("secret",)
#: Values that are keys by their shape: long lower-case hexadecimal numbers with a letter and a digit, and access key ids.
SECRET_SEED = r"^(?:(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}|AKIA[0-9A-Z]{16})$"
ROUNDS = 3
#: A pattern counts from this many distinct known instances, this sure; an instance from this sure.
SUPPORT, PATTERN_SURE, INSTANCE_SURE = 5, 0.7, 0.95
#: What an unknown instance weighs against a pattern.
UNKNOWN = 0.25
#: Characters beside a span in which its neighbouring words are looked for.
CONTEXT = 64

#: Possessive forms of the contract's patterns: what follows a run never begins inside it, so nothing is lost, and no text
#: makes the matcher go back over a long run or nest calls. A match of the first begins at its run's start or where the last match ended.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "": r"(?<![^\s@<>])[^\s@<>]++@[^\s@<>]++|\(?[0-9]++(?:[\x20().-]{1,3}[0-9]++)*+",
    "key": r"(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]{8,}+",
}
_MARKS = {"email": "contains(text, '@')", "ip": "_digits", "card": "_digits", "phone": "contains(text, '+') AND _digits", "": "_digits OR contains(text, '@')", "key": "_digits"}


def _digits(c):
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits):
    """Whether a string of digits passes Luhn's test."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.floor(d.cast("int") * 2 / 10).cast("int") + (d.cast("int") * 2) % 10))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid():
    """Whether a match counts: the parts of an ip, a card's digits and test, a phone's digits; candidates need seven digits or an @."""
    v, n = F.col("value"), F.length(_digits(F.col("value")))
    ip = F.expr(r"forall(split(value, '\\.'), x -> length(regexp_replace(x, '^0+', '')) <= 3 AND coalesce(try_cast(regexp_replace(x, '^0+', '') AS int), 0) <= 255)")
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", ip)
        .when(F.col("kind") == "card", n.between(16, 19) & F.when(n.between(16, 19), _luhn(_digits(v))).otherwise(False))
        .when(F.col("kind") == "phone", n.between(8, 15))
        .when(F.col("kind") == "key", v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
        .otherwise(v.contains("@") | (n >= 7))
    )


def _spans(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, _text, base, seen): each row's base spans and candidate spans in order.

    Spark gives matches and what lies between them, not places; places are running sums of their lengths, taken over rows
    of one match each, so that a text of any number of matches costs no more than its length.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_digits", F.col("text").rlike("[0-9]"))
    names = {k: f"_{i}" for i, k in enumerate(PATTERNS)}
    cut = [F.when(F.expr(_MARKS[k]), F.regexp_extract_all("text", F.lit(p), 0)).alias(f"{names[k]}m") for k, p in PATTERNS.items()]
    cut += [F.when(F.expr(_MARKS[k]), F.split("text", p, -1)).alias(f"{names[k]}p") for k, p in PATTERNS.items()]
    rows = rows.select("_row", "doc_id", F.xxhash64("text").alias("_text"), *cut)
    each = []
    for k, n in names.items():
        m, p = f"{n}m", f"{n}p"
        each.append(f"""CASE WHEN size({m}) > 0 THEN transform(sequence(0, size({m}) - 1), i -> named_struct('kind', '{k}', 'i', i, 'gap', length({p}[i]), 'len', length({m}[i]),
            'value', {m}[i], 'left', lower(right({p}[i], {CONTEXT})), 'right', lower(left({p}[i + 1], {CONTEXT})))) ELSE array() END""")
    rows = rows.select("_row", "doc_id", "_text", F.expr(f"inline_outer(concat({', '.join(each)}))"))
    matches = stored(rows, "pii-matches")
    before = Window.partitionBy("_row", "kind").orderBy("i")
    rows = matches.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.withColumn("ok", F.col("kind").isNotNull() & _valid()).drop("gap", "len", "i")
    #: Base spans that begin up to a span's start and how far they reach, and the first that begins behind it: sums over the order of starts.
    based = F.col("ok") & F.col("kind").isin(*KINDS)
    upto = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_over", F.max(F.when(based, F.col("end"))).over(upto) > F.col("start")).withColumn("_under", F.min(F.when(based, F.col("start"))).over(after) < F.col("end"))
    clear = ~F.coalesce(F.col("_over"), F.lit(False)) & ~F.coalesce(F.col("_under"), F.lit(False))
    span = F.struct("kind", "start", "end", "value", "left", "right")
    found = rows.groupBy("_row", "doc_id", "_text").agg(
        F.array_sort(F.collect_list(F.when(based, span))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("ok") & ~F.col("kind").isin(*KINDS) & clear, span))).alias("seen")
    )
    out = stored(found, "pii-spans", files_like(matches))
    discard(matches)
    return out


def _patterns(left, right):
    """The lexical patterns of a span: words before and behind it, each run of digits as one."""
    word = lambda c, shape: F.nullif(F.regexp_replace(F.regexp_extract(c, shape, 1), "[0-9]+", "0"), F.lit(""))
    before = [word(left, rf"((?:\S+\s+){{{n}}}\S+)\s*$") for n in range(3)]
    behind = [word(right, rf"^\s*(\S+(?:\s+\S+){{{n}}})") for n in range(2)]
    named = [F.concat(F.lit(f"<{n}:"), c) for n, c in enumerate(before, 1)] + [F.concat(F.lit(f">{n}:"), c) for n, c in enumerate(behind, 1)]
    return F.array_compact(F.array(*named, F.concat(F.lit("<>:"), before[0], F.lit(" _ "), behind[0])))


def _shapes(value):
    """The kinds that an unknown value's form allows."""
    n = F.length(_digits(value))
    kinds = [
        F.when(value.contains("@"), F.lit("email")),
        F.when(value.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.lit("ip")),
        F.when(~value.contains("@") & n.between(13, 19), F.lit("card")),
        F.when(~value.contains("@") & n.between(7, 15), F.lit("phone")),
        F.when(value.rlike("^[A-Za-z0-9+/_-]{12,}$") & value.rlike("[A-Za-z]") & (n > 0), F.lit("secret")),
    ]
    return F.array_compact(F.array(*kinds))


def discovered(spans: DataFrame, secret: str = SECRET_SEED) -> DataFrame:
    """(value, kind) of the keys that are seeds and of the unseen identifiers that sure patterns find."""
    files = files_like(spans)
    both = [spans.select(F.expr(f"inline({c})")) for c in ("base", "seen")]
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).when((F.col("kind") == "key") & F.col("value").rlike(secret), F.lit(ADDED[0]))
    rows = both[0].unionByName(both[1]).select("value", known.alias("known"), _patterns(F.col("left"), F.col("right")).alias("beside"))
    edges = rows.select("value", "known", F.explode_outer("beside").alias("pattern"))
    edges = stored(edges.groupBy("pattern", "value").agg(F.max("known").alias("known")), "pii-graph", files)
    seeds = edges.where(F.col("known") == ADDED[0]).select("value", F.col("known").alias("kind")).distinct()
    seeds, all_edges, edges = stored(seeds, "pii-seeds", files), edges, edges.where("pattern is not null")
    totals = edges.groupBy("pattern").agg((F.count("known") + UNKNOWN * F.count_if(F.col("known").isNull())).alias("all"))
    unseen = edges.where("known is null").select("pattern", "value", F.explode(_shapes(F.col("value"))).alias("kind"))
    sure = edges.where("known is not null").select("value", F.col("known").alias("kind")).distinct().withColumn("conf", F.lit(1.0))
    base, rounds = sure, []
    for i in range(ROUNDS):
        known = edges.select("pattern", "value").join(sure, "value")
        by = known.groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"), F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
        patterns = by.join(totals, "pattern").withColumn("p", F.col("mass") / (F.col("all") + 1)).where(F.col("p") >= PATTERN_SURE)
        sides = unseen.join(patterns.select("pattern", "kind", F.least("p", F.lit(0.999)).alias("p")), ["pattern", "kind"]).groupBy("value", "kind", F.regexp_extract("pattern", "^[<>]+", 0)).agg(F.max("p").alias("p"))
        scores = sides.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("conf"))
        best = scores.groupBy("value").agg(F.max(F.struct("conf", "kind")).alias("b")).select("value", "b.kind", "b.conf").where(F.col("conf") >= INSTANCE_SURE)
        rounds.append(stored(best, f"pii-round{i}", files))
        sure = base.unionByName(rounds[-1].select("value", "kind", "conf"))
    out = stored(seeds.unionByName(rounds[-1].select("value", "kind").join(seeds, "value", "left_anti")), "pii-discovered", files)
    for done in (all_edges, seeds, *rounds):
        discard(done)
    return out


def find_spans(docs: DataFrame, secret: str = SECRET_SEED) -> DataFrame:
    """(doc_id, _text, base, spans) of each row of ``docs`` (doc_id, text): spans are structs (kind, start, end)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = _spans(docs)
    new = discovered(spans, secret)
    found = spans.where("size(seen) > 0").select("_row", F.explode("seen").alias("c")).select("_row", "c.start", "c.end", "c.value")
    #: The places of a hot value are written first, so that the join has shuffles of its own and Spark can split it.
    found = stored(found, "pii-seen").join(new.select("value", "kind"), "value").groupBy("_row").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    slim = F.expr("transform(base, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))")
    out = spans.join(found, "_row", "left").select("doc_id", "_text", slim.alias("base"), "more")
    out = stored(out.select("doc_id", "_text", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans")), "pii-found", files_like(spans))
    discard(spans)
    discard(new)
    return out


def _listed(spans):
    """kind:start:end of spans by kind as listed, then start, comma-joined."""
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS + ADDED))
    return F.expr(f"array_join(transform(array_sort(transform({spans}, x -> named_struct('o', CASE x.kind {order} END, 'start', x.start, 'end', x.end, 'kind', x.kind))), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of ``docs`` (doc_id, text); the counts are of base spans."""
    found = find_spans(docs)
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans are replaced as one.

    Only rows that can hold a span (a digit or an @) meet the table of spans; the others pass unchanged. ``n_chars``, where
    there is such a column, follows the new text.
    """
    able = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    found = find_spans(docs.where(able))
    spans = found.where("size(spans) > 0").dropDuplicates(["doc_id", "_text"])
    spans = stored(spans.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), "spans"), "pii-redactions", files_like(found))
    discard(found)
    rows = docs.where(able).select(F.struct(*docs.columns).alias("_all"), "text", F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_key"))
    rows = rows.join(spans, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")), "left")
    merged = F.expr("""aggregate(array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))), cast(array() as array<struct<start:bigint,end:bigint,kind:string>>),
        (a, x) -> CASE WHEN size(a) > 0 AND x.start < element_at(a, -1).end
            THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end), 'kind', element_at(a, -1).kind)))
            ELSE concat(a, array(named_struct('start', x.start, 'end', x.end, 'kind', x.kind))) END)""")
    rows = rows.withColumn("_cut", merged)
    parts = F.expr("""concat(transform(_cut, (x, i) -> concat(substring(text, cast(CASE WHEN i = 0 THEN 0 ELSE _cut[i - 1].end END + 1 as int), cast(x.start - CASE WHEN i = 0 THEN 0 ELSE _cut[i - 1].end END as int)), '[', upper(x.kind), ']')),
        array(substring(text, cast(element_at(_cut, -1).end + 1 as int))))""")
    new = F.when(F.size("_cut") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    rows = rows.withColumn("_new", new)
    kept = {c: F.col(f"_all.`{c}`") for c in docs.columns} | {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(F.size("_cut") > 0, F.length("_new").cast(docs.schema["n_chars"].dataType)).otherwise(kept["n_chars"])
    return docs.where(~able).unionByName(rows.select(*[c.alias(n) for n, c in kept.items()]))
