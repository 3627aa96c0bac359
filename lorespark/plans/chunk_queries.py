"""Queries over the chunker and the converters themselves, with SQL that chunks and converts by its own means."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.operators import catalog, chunking, convert, evidence, lines
from lorespark.plans.oracle import _estimate
from lorespark.plans.registry import ORACLES, _docs, query, table


def _cut(start: str, budget: int) -> str:
    """Where the window of ``body`` from ``start`` ends: behind the last end of a sentence or paragraph in its second half, else at the budget."""
    end = f"least(length(body), {start} + {4 * budget})"
    piece = f"substring(body, {start} + 1, {4 * budget})"
    last = f"""greatest(length(regexp_extract({piece}, '(?s)^.*\\.')) - 1, length(regexp_extract({piece}, '(?s)^.*。')) - 1, length(regexp_extract({piece}, '(?s)^.*\\n\\n')) - 2)"""
    return f"CASE WHEN {end} < length(body) AND {last} > {2 * budget} THEN {start} + {last} + 1 ELSE {end} END"


def chunks_sql(text: str, mode: str, budget: int, overlap: int, minimum: int) -> str:
    """CTEs up to ``chunks`` (all columns of ``chunk_documents``) for a text expression over ``documents`` without fences and wide characters."""
    back = f"greatest(cut - {4 * (overlap - 1) + 1}, 0)" if overlap else "cut"
    fixed = "pieces AS (SELECT doc_id, 0::BIGINT AS piece, 0::BIGINT AS base, text AS body FROM docs WHERE regexp_matches(text, '\\S')), paths AS (SELECT 0::BIGINT AS doc_id, 0::BIGINT AS piece, NULL::VARCHAR AS heading WHERE false)"
    heading = r"""lined AS (SELECT doc_id, unnest(p) AS line, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM docs)),
marked AS (SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a,
  sum(regexp_full_match(line, '#{1,6}\s+.*')::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS piece, regexp_full_match(line, '#{1,6}\s+.*') AS h FROM lined),
heads AS (SELECT doc_id, piece, length(regexp_extract(line, '^#+')) AS level, trim(regexp_extract(line, '^#{1,6}\s+(.*)$', 1)) AS title FROM marked WHERE h),
paths AS (SELECT x.doc_id, x.piece, string_agg(y.title, ' › ' ORDER BY y.piece) AS heading FROM heads x JOIN heads y ON y.doc_id = x.doc_id AND y.piece <= x.piece
  WHERE NOT EXISTS (SELECT 1 FROM heads z WHERE z.doc_id = x.doc_id AND z.piece > y.piece AND z.piece <= x.piece AND z.level <= y.level) GROUP BY 1, 2),
pieces AS (SELECT doc_id, piece, min(a) AS base, string_agg(line, chr(10) ORDER BY i) AS body FROM marked GROUP BY 1, 2 HAVING piece > 0 OR regexp_matches(body, '\S'))"""
    return rf"""docs AS (SELECT doc_id, {text} AS text FROM documents),
{heading if mode == "heading" else fixed},
windows AS (SELECT doc_id, piece, base, body, 0::BIGINT AS start, ({_cut("0", budget)})::BIGINT AS cut FROM pieces
  UNION ALL SELECT doc_id, piece, base, body, next, ({_cut("next", budget)})::BIGINT FROM (SELECT *, greatest({back}, start + 1) AS next FROM windows WHERE cut < length(body))),
sized AS (SELECT doc_id, piece, base + start AS a, base + cut AS b, substring(body, start + 1, cut - start) AS t FROM windows),
judged AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY piece, a) AS k, {_estimate("t")} >= {minimum} AS kept,
  regexp_matches(t, '\S') AND len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S') AND NOT regexp_matches(trim(x), '^(#{{1,6}}\s+\S|#{{1,6}}\s*$)'))) = 0 AS waits FROM sized),
grouped AS (SELECT *, coalesce(sum(kept::INTEGER) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM judged),
waiting AS (SELECT doc_id, g, string_agg(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(10) ORDER BY k) AS lead, min(a) AS a FROM grouped WHERE NOT kept AND waits GROUP BY 1, 2),
bodies AS (
  SELECT x.doc_id, x.piece, k, least(x.a, coalesce(w.a, x.a)) AS a, b, coalesce(lead || chr(10) || chr(10), '') || t AS text FROM grouped x LEFT JOIN waiting w USING (doc_id, g) WHERE kept
  UNION ALL SELECT doc_id, piece, k, a, b, t FROM grouped x WHERE NOT kept AND waits AND NOT EXISTS (SELECT 1 FROM grouped y WHERE y.doc_id = x.doc_id AND y.g = x.g AND y.kept)),
chunks AS (SELECT doc_id, doc_id || '#' || ordinal AS chunk_id, ordinal::INTEGER AS ordinal, text, {_estimate("text")} AS tokens, a AS char_start, b AS char_end,
  CASE WHEN shared > 0 THEN {_estimate("substring(text, 1, shared)")} ELSE 0 END AS overlap_tokens, heading, coalesce(dropped, 0)::BIGINT AS discarded
  FROM (SELECT *, row_number() OVER w - 1 AS ordinal, greatest(coalesce(lag(b) OVER w, 0) - a, 0) AS shared FROM bodies WINDOW w AS (PARTITION BY doc_id ORDER BY k))
  LEFT JOIN paths USING (doc_id, piece) LEFT JOIN (SELECT doc_id, count(*) AS dropped FROM grouped WHERE NOT kept AND NOT waits GROUP BY 1) USING (doc_id))"""


_FIXED = f"WITH RECURSIVE {chunks_sql('text', 'fixed', 512, 64, 1)}"
_MARKDOWN = f"""WITH RECURSIVE {chunks_sql("'# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || text", "heading", 200, 12, 5)}"""
#: Every fifth line a heading; levels go up and down, so that open titles are dropped.
_OUTLINE = """array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 1 THEN repeat('#', (i // 5 * 3 + doc_id) % 4 + 1) || ' part ' || i ELSE x END), chr(10))"""
_SECTIONS = f"WITH RECURSIVE {chunks_sql(_OUTLINE, 'heading', 120, 20, 8)}"


def _checks(budget: int, minimum: int) -> str:
    return f"""f AS (SELECT count(*) AS n, max(tokens) AS most, min(tokens) AS least, count(*) FILTER (overlap_tokens > 0) AS sharing, count(*) FILTER (ordinal > 0) AS followers,
  count(heading) AS headed, max(overlap_tokens) AS widest FROM chunks)
SELECT 'chunks' AS "check", n > 0 AS ok, n AS measured FROM f UNION ALL SELECT 'budget', most <= {budget}, most FROM f UNION ALL SELECT 'minimum', least >= {minimum}, least FROM f
UNION ALL SELECT 'overlap', followers = 0 OR sharing > 0, sharing FROM f UNION ALL SELECT 'overlap_size', widest <= {budget}, widest FROM f UNION ALL SELECT 'headings', true, headed FROM f"""


#: Queries of ``registry`` whose SQL is the chunker's.
ORACLES |= {"chunk_heading": f"{_MARKDOWN} SELECT * FROM chunks", "chunk_fixed": f"{_FIXED} SELECT * FROM chunks", "policy_checks": f"{_MARKDOWN}, {_checks(200, 5)}"}


def _outline(spark, sf_dir):
    level = lambda i: F.floor((i + 1) / 5).cast("int") * 3 + F.col("doc_id")
    head = lambda i: F.concat(F.repeat(F.lit("#"), (level(i) % 4 + 1).cast("int")), F.lit(" part "), (i + 1).cast("string"))
    return _docs(spark, sf_dir).select("doc_id", F.concat_ws("\n", F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i + 1) % 5 == 1, head(i)).otherwise(x))).alias("text"))


def _fixed(spark, sf_dir):
    return chunking.chunk_documents(_docs(spark, sf_dir), chunking.Config("fixed", 512, 64, 1))


def _sections(spark, sf_dir):
    return chunking.chunk_documents(_outline(spark, sf_dir), chunking.Config("heading", 120, 20, 8))


@query(f"{_SECTIONS} SELECT * FROM chunks")
def chunk_sections(spark, sf_dir):
    """Sections under headings whose levels rise and fall, cut, dropped and led by waiting headings."""
    return _sections(spark, sf_dir)


@query(f"{_SECTIONS} SELECT doc_id, piece + 1 AS ordinal, heading FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS piece, heading FROM paths)")
def heading_pops(spark, sf_dir):
    """Paths of headings whose levels rise and fall, by windows over lines."""
    from pyspark.sql import Window

    rows = lines.headings(lines.lines(_outline(spark, sf_dir)))
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")).cast("long").alias("ordinal"), F.col("path").alias("heading"))


@query(f"{_FIXED} SELECT * FROM chunks WHERE ordinal < 5")
def chunk_preview(spark, sf_dir):
    return chunking.preview(_fixed(spark, sf_dir), 5)


@query(f"{_FIXED} SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY 1")
def chunk_counts(spark, sf_dir):
    return _fixed(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query(f"""{_FIXED} SELECT doc_id, count(*) AS chunks, sum(greatest(coalesce(before - char_start, 0), 0))::BIGINT AS overlap_chars
FROM (SELECT *, lag(char_end) OVER (PARTITION BY doc_id ORDER BY ordinal) AS before FROM chunks) GROUP BY 1""")
def chunk_overlap_chars(spark, sf_dir):
    return chunking.overlaps(_fixed(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("overlap_chars").cast("long").alias("overlap_chars"))


@query(f"""{_SECTIONS}, per AS (SELECT doc_id, count(*) AS chunks, max(discarded) AS discarded, sum(tokens) AS tokens, sum(overlap_tokens) AS overlap_tokens FROM chunks GROUP BY 1)
SELECT doc_id, sum(chunks)::BIGINT AS chunks, sum(discarded)::BIGINT AS discarded, sum(tokens)::BIGINT AS tokens, sum(overlap_tokens)::BIGINT AS overlap_tokens,
  floor(sum(tokens) / sum(chunks) + 0.5)::BIGINT AS average_tokens FROM per GROUP BY ROLLUP (doc_id)""")
def chunk_plan(spark, sf_dir):
    return chunking.plan_totals(_sections(spark, sf_dir))


@query(f"""{_FIXED} SELECT doc_id, ordinal, tokens, overlap_tokens, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) AS snippet, char_start, char_end
FROM chunks WHERE ordinal < 8 AND doc_id = (SELECT min(doc_id) FROM chunks)""")
def plan_preview(spark, sf_dir):
    return catalog.first_preview(_fixed(spark, sf_dir))


@query(f"{_SECTIONS}, {_checks(120, 8)}")
def section_checks(spark, sf_dir):
    return evidence.policy_checks(_sections(spark, sf_dir), 120, 20, 8)


@query(f"{_FIXED} SELECT doc_id, ordinal, tokens, char_start, char_end FROM chunks")
def chunk_lateral(spark, sf_dir):
    """The chunker as a table function of SQL."""
    chunking.register_chunk_function(spark)
    _docs(spark, sf_dir).createOrReplaceTempView("chunk_lateral_docs")
    return spark.sql("SELECT d.doc_id, c.ordinal, c.tokens, c.char_start, c.char_end FROM chunk_lateral_docs d, LATERAL chunk(d.text, 'fixed', 512, 64, 1) c")


_TABLE_ROWS = "'| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |'"


@query(f"""WITH RECURSIVE r AS (SELECT c_nationkey AS doc_id, {_TABLE_ROWS} AS line, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
sized AS (SELECT *, {_estimate("chr(10) || line")} AS n FROM r), head AS (SELECT {_estimate("'| key | name | segment |' || chr(10) || '| --- | --- | --- |'")} AS n),
whole AS (SELECT doc_id FROM r GROUP BY 1 HAVING {_estimate("'| key | name | segment |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10))")} <= 60),
packed AS (SELECT doc_id, i, 1 AS part, head.n + s.n AS used FROM sized s, head WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN p.used + s.n > 60 THEN p.part + 1 ELSE p.part END, CASE WHEN p.used + s.n > 60 THEN head.n + s.n ELSE p.used + s.n END
  FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.i = p.i + 1, head)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM whole) THEN 0 ELSE part - 1 END::INTEGER AS ordinal,
  '| key | name | segment |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS text
FROM packed JOIN r USING (doc_id, i) GROUP BY 1, 2""")
def chunk_tables(spark, sf_dir):
    """Tables over the budget in windows of whole rows under a repeated header."""
    row = F.concat_ws(" | ", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.struct("c_custkey", F.concat(F.lit("| "), row, F.lit(" |")).alias("line")).alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n")
    docs = rows.groupBy("doc_id").agg(F.concat(F.lit("| key | name | segment |\n| --- | --- | --- |\n"), body).alias("text"))
    chunks = chunking.chunk_documents(docs, chunking.Config("fixed", 60, 0, 0, split_tables_by_row=True))
    return chunks.select("doc_id", "ordinal", "text")


# Reading and converting


@query("""SELECT doc_id, text || chr(10) || 'a' || chr(10) || chr(10) || 'b' AS text FROM documents""")
def ingested_texts(spark, sf_dir):
    """Uploads with a byte-order mark and carriage returns, as the store keeps them."""
    raw = F.concat(F.lit("﻿"), F.regexp_replace("text", "\n", "\r\n"), F.lit("\ra\r\r\nb"))
    return _docs(spark, sf_dir).select("doc_id", T.ingested(raw).alias("text"))


@query("""SELECT n_nationkey AS page_id, '# ' || n_name || chr(10) || chr(10) || 'key ' || n_nationkey || ' of [all](http://n/' || n_regionkey || ')' || chr(10) || chr(10) || '- a < b' || chr(10) || '- ' || lower(n_name)
  || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | x｜y |' || chr(10) || chr(10) || '```sql' || chr(10) || 'select' || chr(10) || '  1' || chr(10) || '```' || chr(10) AS text,
  'structured' AS structure FROM nation""")
def html_blocks(spark, sf_dir):
    """Pages of headings, links, lists, tables and code, some tags left open, to Markdown."""
    n, k = F.col("n_name"), F.col("n_nationkey").cast("string")
    parts = [
        "<html><head><title>t</title><style>p{}</style></head><body><!-- c --><script>var x='<p>';</script><h1>", n, "</h1><p>key <b>", k, "</b> of <a href=\"http://n/", F.col("n_regionkey").cast("string"),
        "\">all</a><ul><li>a &lt; b<li>", F.lower(n), "</ul><table><tr><th>key<th>name</tr><tr><td>", k, "<td>x|y</table><pre><code class=\"language-sql\">select\n  1</code></pre></body></html>",
    ]
    html = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return convert.convert_html(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page_id"), html.alias("html")), "page_id", "html")


@query("""SELECT n_name || '.csv' AS name, '## ' || n_name || chr(10) || chr(10) || '| key | note |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ab c |' AS text, 'structured' AS structure, false AS failed FROM nation
UNION ALL SELECT n_name || '.json', '```json' || chr(10) || '{' || chr(10) || '  "key": ' || n_nationkey || ',' || chr(10) || '  "in": [' || chr(10) || '    ' || n_regionkey || chr(10) || '  ]' || chr(10) || '}' || chr(10) || '```', 'flat-text', false FROM nation
UNION ALL SELECT n_name || '.bad.json', '```' || chr(10) || '{' || n_name || chr(10) || '```', 'flat-text', false FROM nation
UNION ALL SELECT n_name || '.txt', n_name || chr(10) || 'end', 'unparsed', false FROM nation UNION ALL SELECT n_name || '.exe', NULL, NULL, true FROM nation""")
def converted_files(spark, sf_dir):
    """Tables with a delimiter of their own, good and bad JSON, plain text and what has no converter, as files."""
    n, k, r = F.col("n_name"), F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    contents = {
        ".csv": F.concat(F.lit("﻿key;note\r\n\r\n"), k, F.lit(";ab c\r\n")), ".json": F.concat(F.lit('{"key":'), k, F.lit(',"in":['), r, F.lit("]}")), ".bad.json": F.concat(F.lit("{"), n),
        ".txt": F.concat(F.lit("﻿"), n, F.lit("\r\nend")), ".exe": F.lit("x"),
    }
    files = F.array(*[F.struct(F.concat(n, F.lit(e)).alias("name"), c.alias("content")) for e, c in contents.items()])
    rows = table(spark, sf_dir, "nation").select(F.inline(files)).select("name", F.col("content").cast("binary").alias("content"))
    return convert.convert_files(rows).select("name", "text", "structure", "failed")
