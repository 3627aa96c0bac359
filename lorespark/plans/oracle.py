"""DuckDB SQL that gives the rows of the queries in ``registry``."""

_RECORDS = """
records AS (
  SELECT d.doc_id, d.source AS collection, d.source || '/' || d.doc_id || '.md' AS name,
    CASE WHEN l.quality = 1 THEN 'ready' WHEN l.quality = 0 THEN 'failed' ELSE 'pending' END AS status,
    CASE WHEN l.quality = 1 THEN ceil(d.n_chars / 1000)::BIGINT END AS chunks, strlen(d.text)::BIGINT AS bytes,
    CASE WHEN l.toxic = 1 THEN 'html' END AS converter, CASE WHEN l.quality = 1 THEN 'structured' WHEN l.quality = 0 THEN 'flat-text' END AS structure
  FROM documents d LEFT JOIN labels l USING (doc_id)),
collections AS (
  SELECT collection, 'Library ' || collection AS name,
    CASE WHEN arg_min(status, doc_id) <> 'pending' THEN TIMESTAMP '2024-01-01' + to_days(min(doc_id)::INTEGER) END AS built_at
  FROM records GROUP BY collection),
summaries AS (
  SELECT collection, count(*) AS documents, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'pending') AS pending,
    count(*) FILTER (status = 'failed') AS failed, sum(coalesce(chunks, 0))::BIGINT AS chunks
  FROM records GROUP BY collection)"""

_DENSE = """
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS id, greatest(0, least(1, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS score
  FROM embeddings q JOIN embeddings c ON true WHERE q.vec_id % 20 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM pairs)"""

_BAND = "CASE WHEN score >= 0.85 THEN 'strong' WHEN score >= 0.70 THEN 'relevant' WHEN score >= 0.55 THEN 'fair' ELSE 'low' END"

DENSE_TOPK = f"WITH {_DENSE} SELECT query_id, rank, id, round(score, 6) AS score, {_BAND} AS band FROM dense WHERE rank <= 8 AND score >= 0.2"

DENSE_BELOW_FLOOR = f"""WITH {_DENSE}
SELECT query_id, count(*) FILTER (score < 0.2) AS below_floor, count(*) FILTER (score >= 0.2) AS kept FROM dense WHERE rank <= 100 GROUP BY query_id"""

_TOKENS = r"tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)"

#: A query's text: the first three words of the document that has the vector's id.
_ASKED = r"""asked AS (SELECT e.vec_id AS query_id, unnest(list_distinct(coalesce(regexp_extract_all(lower(d.text), '[\p{L}\p{N}]+')[1:3], []))) AS term
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 20 = 0)"""


def fts(texts: str = "documents", everything: str = "tok", asked: str = _ASKED) -> str:
    """CTEs up to ``fts`` (query_id, id, bm, rank): the BM25 ranks of every document (doc_id, text) that holds one of a query's terms."""
    return rf"""tok AS (SELECT doc_id AS id, coalesce(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), []) AS t FROM {texts}), {asked},
words AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM tok),
tf AS (SELECT id, dl, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
corpus AS (SELECT n, avgdl FROM (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM {everything})),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS bm
  FROM asked JOIN tf USING (term) JOIN df USING (term), corpus GROUP BY 1, 2),
fts AS (SELECT query_id, id, bm, row_number() OVER (PARTITION BY query_id ORDER BY bm DESC, id) AS rank FROM bm)"""


FTS_BM25_TOPK = f"WITH {fts()} SELECT query_id, rank, id, round(bm, 6) AS score FROM fts WHERE rank <= 20"

POSTINGS = f"""WITH {_TOKENS}, p AS (SELECT unnest(t) AS term, id FROM tok), tf AS (SELECT term, id, count(*) AS tf FROM p GROUP BY 1, 2)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM tf GROUP BY term"""

_EVERY = "(SELECT t FROM tok FULL OUTER JOIN embeddings e ON e.vec_id = tok.id)"
_FUSED = f"""WITH {_DENSE}, {fts(everything=_EVERY)},
d AS (SELECT query_id, id, score, rank FROM dense WHERE rank <= 100),
f AS (SELECT query_id, id, rank FROM fts WHERE rank <= 100),
fused AS (
  SELECT coalesce(d.query_id, f.query_id) AS query_id, coalesce(d.id, f.id) AS id, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + f.rank), 0) AS rrf,
    d.rank AS dense_rank, f.rank AS fts_rank, coalesce(d.score, 0.2) AS score
  FROM d FULL OUTER JOIN f ON d.id = f.id AND d.query_id = f.query_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, coalesce(dense_rank, 2147483648), id) AS rank FROM fused WHERE score >= 0.2)"""

HYBRID_RRF_TOPK = f"{_FUSED} SELECT query_id, rank, id, round(score, 6) AS score, {_BAND} AS band, dense_rank, fts_rank FROM hits WHERE rank <= 20"

HYBRID_STATS = f"""{_FUSED} SELECT query_id, CASE WHEN count(fts_rank) > 0 THEN 'hybrid' ELSE 'dense' END AS mode, count(*) FILTER (score < 0.2) AS below_floor,
  count(*) FILTER (dense_rank IS NULL AND score >= 0.2) AS fts_only_hits FROM fused GROUP BY query_id"""

HYBRID_WITH_DOCUMENTS = f"""{_FUSED} SELECT query_id, rank, id, coalesce(source || '/' || doc_id, id::VARCHAR) AS name, round(score, 4) AS match_score, {_BAND} AS band
FROM hits LEFT JOIN documents ON doc_id = id WHERE rank <= 8"""

_STORED = {
    "INT8": "list_transform(e, lambda x: CASE WHEN s > 0 THEN round(x / (s / 127.0::DOUBLE)) * (s / 127.0::DOUBLE) ELSE 0 END)",
    "INT4": "list_transform(e, lambda x: CASE WHEN s > 0 THEN round(x / (s / 7.0::DOUBLE)) * (s / 7.0::DOUBLE) ELSE 0 END)",
    "FP16": "list_transform(e, lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x / pow(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0::DOUBLE, greatest(floor(log2(abs(x))), -14) - 10) END)",
}


def rescored(quantizer: str, oversample: int) -> str:
    """CTEs up to ``best_<quantizer>`` (query_id, id, score, rank): the first k * oversample by what the codes hold, scored again on the vectors; with ``dense``."""
    n = quantizer.lower()
    return f"""kept_{n} AS (SELECT vec_id, {_STORED[quantizer]} AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS s FROM embeddings)),
near_{n} AS (SELECT query_id, id FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
  round(greatest(0, least(1, list_cosine_similarity(c.v, q.embedding::DOUBLE[]))), 9) DESC, c.vec_id) AS place FROM embeddings q JOIN kept_{n} c ON true WHERE q.vec_id % 20 = 0) WHERE place <= {8 * oversample}),
best_{n} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM near_{n} JOIN pairs USING (query_id, id))"""


def _rescored_topk(quantizer: str, oversample: int) -> str:
    return f"WITH {_DENSE}, {rescored(quantizer, oversample)} SELECT query_id, rank, id, round(score, 6) AS score FROM best_{quantizer.lower()} WHERE rank <= 8"


QUANTIZED_TOPK, QUANTIZED_INT4_TOPK, QUANTIZED_FP16_TOPK = _rescored_topk("INT8", 4), _rescored_topk("INT4", 16), _rescored_topk("FP16", 4)
_RECALL = "SELECT '{q}' AS index, (SELECT count(*) FROM exact) AS exact, (SELECT count(*) FROM exact JOIN best_{n} USING (query_id, id) WHERE best_{n}.rank <= 8) AS found"
#: Cells have no SQL of their own: that nine tenths are found is all that is known beforehand.
INDEX_RECALLS = f"""WITH {_DENSE}, exact AS (SELECT query_id, id FROM dense WHERE rank <= 8), {rescored("FP16", 4)}, {rescored("INT8", 4)}, {rescored("INT4", 16)}
SELECT *, found >= 0.9 * exact AS enough FROM ({" UNION ALL ".join(_RECALL.format(q=q, n=q.lower()) for q in ("FP16", "INT8", "INT4"))})
UNION ALL SELECT 'cells', (SELECT count(*) FROM exact), NULL, true"""

HASH_EMBED_NORM = """WITH c AS (SELECT doc_id, list_transform(string_split(text, ''), lambda x: unicode(x)::BIGINT) AS c FROM documents WHERE length(text) > 0),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i < len(c) THEN (c[i] % 1024 * 31 + c[i + 1]) % 1024 ELSE c[i] % 1024 END)) AS bucket FROM c),
n AS (SELECT doc_id, bucket, count(*) AS n FROM b GROUP BY 1, 2)
SELECT doc_id, count(*) AS buckets, sum(n * n)::BIGINT AS squared_length FROM n GROUP BY doc_id"""

_WIDE = r"[^\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2EBEF}]"


def _estimate(t: str) -> str:
    wide = f"length(regexp_replace({t}, '{_WIDE}', '', 'g'))"
    return f"({wide} + ceil((length({t}) - {wide}) / 4))::BIGINT"


TOKEN_ESTIMATE = f"SELECT doc_id, {_estimate('text')} AS tokens FROM documents"

CHUNK_PARAGRAPH = f"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS t FROM documents),
q AS (SELECT doc_id, regexp_replace(t, '^\\n+|\\n+$', '', 'g') AS t FROM p WHERE regexp_matches(t, '\\S'))
SELECT doc_id, count(*) AS chunks, sum({_estimate("t")})::BIGINT AS tokens FROM q GROUP BY doc_id"""

CHUNK_WINDOWS = """WITH n AS (SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(text, '[^\\s.。]')),
w AS (SELECT doc_id, n, CASE WHEN n <= 800 THEN 1 ELSE 1 + ceil((n - 800) / 603.0)::BIGINT END AS chunks FROM n)
SELECT doc_id, chunks, ((chunks - 1) * 50)::BIGINT AS overlap_tokens FROM w"""

CHUNK_OVERLAP = """WITH n AS (SELECT doc_id, length(text) AS n FROM documents),
c AS (SELECT doc_id, n, unnest(range(0, greatest(ceil(n / 700)::BIGINT, 1))) AS k FROM n),
w AS (SELECT doc_id, k, k * 700 AS a, least(k * 700 + 800, n) AS b FROM c),
o AS (SELECT doc_id, greatest(coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k) - a, 0), 0) AS o FROM w)
SELECT doc_id, count(*) AS chunks, sum(o)::BIGINT AS overlap_chars FROM o GROUP BY doc_id"""

BUILD_PLAN = f"""WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(ceil(length(text) / 1000)::BIGINT, 1))) AS k FROM documents),
p AS (SELECT doc_id, substring(text, k * 1000 + 1, 1000) AS t FROM c), s AS (SELECT doc_id, {_estimate("t")} AS tokens FROM p)
SELECT doc_id, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, floor(sum(tokens) / count(*) + 0.5)::BIGINT AS average_tokens FROM s GROUP BY ROLLUP (doc_id)"""

COST_ESTIMATE = f"""WITH {_RECORDS}, t AS (SELECT collection, sum(coalesce(chunks, 0))::BIGINT AS chunks FROM records GROUP BY collection)
SELECT collection, chunks, chunks * 4096 AS raw_bytes, chunks * 1024 AS vector_bytes, greatest(1, floor(chunks / 40 + 0.5))::BIGINT AS seconds, 4.0::DOUBLE AS compression FROM t"""

_LINES = """parts AS (SELECT doc_id, string_split({text}, chr(10)) AS p FROM documents),
lines AS (SELECT doc_id, unnest(p) AS text, unnest(range(1, len(p) + 1)) AS line FROM parts),
placed AS (SELECT doc_id, line, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines)"""
_PLAIN = _LINES.format(text="text")

LINE_OFFSETS = f"WITH {_PLAIN} SELECT doc_id, line, start, length(text)::BIGINT AS length FROM placed"

FENCE_PARITY = f"""WITH {_PLAIN}, f AS (SELECT doc_id, line, (line - 1) % 9 = 4 AS fence FROM lines),
o AS (SELECT doc_id, sum(fence::INTEGER) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 1 AS open FROM f)
SELECT doc_id, count(*) FILTER (open) AS inside, count(*) FILTER (NOT open) AS outside FROM o GROUP BY doc_id"""

HEADING_PATHS = """SELECT doc_id, 1::BIGINT AS line, 1::BIGINT AS level, source AS title, source AS path FROM documents
UNION ALL SELECT doc_id, 3, 2, lang, source || ' › ' || lang FROM documents"""

LINE_OF_OFFSET = "SELECT doc_id, (length(substring(text, 1, 500)) - length(replace(substring(text, 1, 500), chr(10), '')) + 1)::BIGINT AS line FROM documents"

CITATION_WINDOW = f"""WITH {_PLAIN}, c AS (SELECT doc_id, length(substring(text, 1, 300)) - length(replace(substring(text, 1, 300), chr(10), '')) + 1 AS cited FROM documents)
SELECT doc_id, line, text, line = cited AS is_cited, start <= 350 AND start + length(text) >= 250 AS in_chunk FROM placed JOIN c USING (doc_id) WHERE abs(line - cited) <= 2"""

DOCUMENT_SUMMARY = f"WITH {_RECORDS} SELECT * FROM summaries"

_VIEW = """views AS (SELECT collection, name, CASE WHEN built_at IS NULL THEN 'pending' WHEN failed > 0 THEN 'failed' ELSE 'ready' END AS status, documents, chunks FROM collections LEFT JOIN summaries USING (collection))"""
COLLECTION_VIEW = f"WITH {_RECORDS}, {_VIEW} SELECT * FROM views"
OVERVIEW = f"WITH {_RECORDS}, {_VIEW} SELECT coalesce(sum(documents), 0)::BIGINT AS documents, count(*) FILTER (status = 'ready') AS ready, count(*) AS collections FROM views"

PARSER_SUMMARY = f"""WITH {_RECORDS}
SELECT collection, array_to_string(list_sort(list_distinct(list(coalesce(converter, 'verbatim')))), ',') AS converters, array_to_string(list_sort(list_distinct(list(coalesce(structure, 'unparsed')))), ',') AS structures
FROM records GROUP BY collection"""

BUILD_SCOPE = f"WITH {_RECORDS} SELECT count(*) AS documents, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM records WHERE status <> 'ready' AND NOT (status = 'failed' AND converter IS NOT NULL)"

QUOTA = f"""WITH {_RECORDS}, u AS (SELECT sum(bytes)::BIGINT AS used FROM records)
SELECT used, 5000000::BIGINT AS "limit", round(used / 5000000, 6) AS fraction, used / 5000000 >= 0.9 AS near_limit, used >= 5000000 AS exceeded FROM u"""

RECONCILE = f"""WITH {_RECORDS}, s AS (SELECT source AS collection, count(*) AS served FROM documents GROUP BY 1)
SELECT collection, chunks AS recorded, served, chunks - served AS difference FROM summaries JOIN s USING (collection)"""

NOT_SERVED = f"""WITH {_RECORDS} SELECT doc_id, collection FROM records JOIN collections c USING (collection)
WHERE c.built_at IS NULL OR TIMESTAMP '2024-01-05' > c.built_at OR coalesce(chunks, 0) = 0"""

MERGE_RECORDS = f"""WITH {_RECORDS}, b AS (SELECT doc_id + 100 AS doc_id, 'ready' AS status, (quality + 1)::BIGINT AS chunks FROM labels)
SELECT doc_id, CASE WHEN r.status = 'failed' THEN 'failed' ELSE coalesce(b.status, r.status) END AS status, coalesce(b.chunks, r.chunks) AS chunks FROM records r FULL OUTER JOIN b USING (doc_id)"""

UPLOAD_VERDICTS = r"""WITH n AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS name, strlen(html) AS size FROM pages),
b AS (SELECT page_id, size, regexp_extract(name, '([^/\\]*)$', 1) AS base FROM n),
e AS (SELECT page_id, size, CASE WHEN regexp_matches(base, '^[^.].*\.[^.]+$|^[^.]\.[^.]+$') THEN lower(regexp_extract(base, '\.([^.]+)$', 1)) ELSE '' END AS extension FROM b),
f AS (SELECT *, CASE WHEN extension IN ('md', 'markdown', 'txt') THEN 'verbatim' WHEN extension = 'htm' THEN 'html' WHEN extension IN ('pdf', 'html', 'docx', 'xlsx', 'csv', 'json') THEN extension ELSE 'unsupported' END AS format FROM e)
SELECT page_id, extension, format, CASE WHEN format = 'unsupported' THEN 'unsupported file type' WHEN coalesce(size, 0) < 1 THEN 'file is empty' WHEN size > 33554432 THEN 'file is over 32 MB' END AS reason FROM f"""

RESOLVE = f"""WITH {_RECORDS}, asked AS (SELECT * FROM (VALUES ('src1', 'src1'), (' SRC1 ', 'src1'), ('library src2', 'library src2'), ('src', 'src'), ('lib', 'lib'), ('look in “src3” please', 'src3'),
  ('', ''), ('  ', ''), ('nothing', 'nothing'), ('Library src1', 'library src1')) t(wanted, q)),
m AS (SELECT wanted, collection, CASE WHEN lower(collection) = q THEN 1 WHEN lower(name) = q THEN 2 WHEN starts_with(lower(collection), q) OR starts_with(lower(name), q) THEN 3 END AS tier FROM asked, collections WHERE q <> ''),
b AS (SELECT wanted, collection, tier, min(tier) OVER (PARTITION BY wanted) AS best FROM m WHERE tier IS NOT NULL),
f AS (SELECT wanted, count(*) AS n, min(collection) AS c FROM b WHERE tier = best GROUP BY wanted)
SELECT wanted, CASE WHEN q = '' THEN 'empty' WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status, CASE WHEN n = 1 THEN c END AS collection FROM asked LEFT JOIN f USING (wanted)"""

CANDIDATE_COLLECTIONS = f"WITH {_RECORDS} SELECT collection, name, built_at IS NOT NULL AS built FROM collections WHERE contains(lower(name), 'src1') OR contains(lower(collection), 'src1')"

HITS_7D = "SELECT event_type, count(*)::BIGINT AS hits FROM events WHERE ts > TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20' GROUP BY event_type"

HITS_SLIDING = """WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS hits FROM events GROUP BY 1, 2)
SELECT a.event_type, strftime(a.day, '%Y-%m-%d') AS day, a.hits, sum(b.hits)::BIGINT AS hits_window FROM d a JOIN d b ON a.event_type = b.event_type AND b.day BETWEEN a.day - 6 AND a.day GROUP BY a.event_type, a.day, a.hits"""

PROGRESS = "SELECT user_id AS job, event_id AS at, round(max((event_id % 97) / 100) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS fraction FROM events"

_RANGES = f"""{_PLAIN}, ranges AS (SELECT doc_id, start, start + length(text) AS stop FROM placed),
cuts AS (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(ceil(length(text) / 400)::BIGINT, 1))) AS k FROM documents),
chunks AS (SELECT doc_id, k * 400 AS a, least(k * 400 + 400, n) AS b FROM cuts)"""

RETAINED_ROWS = f"WITH {_RANGES} SELECT doc_id, count(*) AS lines FROM ranges r WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = r.doc_id AND r.start >= a AND r.stop <= b) GROUP BY doc_id"

INTERVAL_OVERLAP = f"WITH {_RANGES} SELECT doc_id, sum(least(stop, b) - greatest(start, a))::BIGINT AS covered FROM ranges JOIN chunks USING (doc_id) WHERE start < b AND stop > a GROUP BY doc_id"

DISCARDED_ANTI = f"WITH {_PLAIN} SELECT doc_id, start AS char_start, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 400) AS text FROM placed WHERE {_estimate('text')} < 20"

LONGEST = "SELECT doc_id, length(text)::BIGINT AS chars FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1"

HTML_STRIP = r"SELECT page_id, length(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'))::BIGINT AS chars FROM pages"

UNSAFE_URLS = "SELECT page_id, true AS unsafe, regexp_matches(url, '^(?i)(javascript|data|vbscript):') AS plain FROM pages"

ROWS_TO_TABLE = """SELECT n_regionkey AS sheet, '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) ||
  string_agg('| ' || n_nationkey || ' | ' || n_name || ' | a｜b' || n_nationkey || ' |', chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY 1"""

JSON_WALK = "SELECT event_id, unnest(json_keys(props)) AS path, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events"

STRUCTURE_GRADE = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'flat-text' WHEN doc_id % 2 = 0 THEN 'structured' ELSE 'inferred' END AS structure FROM documents"

DOC_IDS = """WITH c AS (SELECT doc_id, list_concat(list_transform(string_split(source, ''), lambda x: unicode(x)::BIGINT), [0::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)) AS c FROM documents)
SELECT doc_id, 'doc_' || lpad(lower(printf('%x', list_reduce(c, lambda h, u: (xor(h, u) * 16777619) % 4294967296, 2166136261::BIGINT))), 8, '0') AS id FROM c"""

COLLECTION_IDS = "SELECT DISTINCT source, substring(regexp_replace(lower(source), '[^a-z0-9]', '', 'g'), 1, 16) AS domain, true AS valid FROM documents"

CITATION_ADDRESS = "SELECT page_id, 'kb://my%20lib%2F%C3%A4/' || url_encode(url) || '#L' || (page_id + 1) AS address, url AS doc, (page_id + 1)::BIGINT AS line FROM pages"

FORMAT_BYTES = """WITH b AS (SELECT doc_id, (strlen(text) * doc_id)::DOUBLE AS n FROM documents),
u AS (SELECT doc_id, n / pow(1024, i) AS x, i, ['B', 'KB', 'MB', 'GB', 'TB'][i + 1] AS unit FROM (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS i FROM b))
SELECT doc_id, CASE WHEN i > 0 AND x < 10 THEN printf('%d.%d %s', floor(x * 10 + 0.5)::BIGINT // 10, floor(x * 10 + 0.5)::BIGINT % 10, unit) ELSE printf('%d %s', floor(x + 0.5)::BIGINT, unit) END AS shown FROM u"""

INCREMENTAL = "SELECT count(*) AS rows, sum(CASE WHEN l.quality = 0 THEN 2 ELSE 1 END * length(text))::BIGINT AS size FROM documents d LEFT JOIN labels l USING (doc_id)"

STREAM_COUNTS = "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS hits FROM events GROUP BY 1, 2"

# Lists and reports

BUILD_RECORDS = f"WITH {_RECORDS}, {_VIEW} SELECT c.built_at AS at, c.collection, v.chunks, v.status FROM collections c JOIN views v USING (collection) WHERE c.built_at IS NOT NULL"

DOCUMENT_LIST = f"WITH {_RECORDS} SELECT doc_id, name, bytes, status, chunks, structure, 'md' AS extension FROM records"

FILTER_DOCUMENTS = f"WITH {_RECORDS} SELECT doc_id, name FROM records WHERE status = 'ready' AND contains(lower(name), 'src1/')"

FILTER_COLLECTIONS = f"WITH {_RECORDS}, {_VIEW} SELECT collection, name FROM views WHERE contains(lower(name), 'src1') OR contains(lower(collection), 'src1')"

INSPECTION = f"""WITH {_RECORDS}, {_VIEW}, s AS (SELECT source AS collection, count(*) AS served FROM documents GROUP BY 1),
missing AS (SELECT r.collection, count(*) AS n FROM records r JOIN collections c USING (collection)
  WHERE c.built_at IS NULL OR TIMESTAMP '2024-01-05' > c.built_at OR coalesce(r.chunks, 0) = 0 GROUP BY 1)
SELECT v.collection, v.status, t.documents, t.ready, t.pending, t.failed, t.chunks, s.served, t.chunks - s.served AS difference, coalesce(m.n, 0) AS not_served
FROM views v JOIN summaries t USING (collection) JOIN s USING (collection) LEFT JOIN missing m USING (collection)"""

FIRST_PREVIEW = f"""WITH f AS (SELECT min(doc_id) AS doc_id FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, unnest(range(0, least(8, ceil(length(text) / 700)::BIGINT))) AS k, text FROM documents JOIN f USING (doc_id))
SELECT doc_id, k AS ordinal, {_estimate('substring(text, k * 700 + 1, 800)')} AS tokens, k * 700 AS char_start, least(k * 700 + 800, length(text))::BIGINT AS char_end FROM c"""

CHUNK_COUNTS = f"WITH {_RANGES} SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY doc_id"

SOURCE_PATHS = """SELECT doc_id, 'store/' || source || '/doc_' || doc_id || '.v1.md' AS path, 'doc_' || doc_id || '.v1' AS found, '' AS other FROM documents"""

STAMPS = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events"

HIT_LINES = """SELECT doc_id, 3 AS rank, 'fair' AS band, round(0.5 + doc_id % 50 / 100, 2) AS score, source || '/doc_' || doc_id || '.md' AS name, (doc_id + 1)::INTEGER AS line,
  10 AS char_start, n_chars::INTEGER AS char_end, 'doc_' || doc_id AS found FROM documents"""

WIDE_TEXTS = r"SELECT doc_id, regexp_matches(coalesce(text, ''), '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{2EBEF}]') AS wide FROM documents"

BUILD_ERRORS = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'the index was closed by a build that was stopped; submit the build again'
  WHEN 1 THEN 'the index is in use by another build; try again shortly' ELSE 'event ' || event_id END AS message FROM events"""

STREAM_SLIDING = """WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT (day - to_days(k::INTEGER))::TIMESTAMP AS window_start, event_type, sum(n)::BIGINT AS hits FROM d, range(0, 7) r(k) GROUP BY 1, 2"""

QUANTIZED_CODES = """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) AS m FROM v)
SELECT id, len(v)::INTEGER AS size, list_sum(list_transform(v, lambda x: round(x / (m / 127.0))))::BIGINT AS int8, list_sum(list_transform(v, lambda x: round(x / (m / 7.0))))::BIGINT AS int4 FROM s"""

DENSE_ALL_CELLS = f"WITH {_DENSE} SELECT query_id, rank, id, round(score, 6) AS score FROM dense WHERE rank <= 8"
