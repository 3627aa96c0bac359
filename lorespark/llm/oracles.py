"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.node),
comp AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp ON comp.node = d.doc_id
"""


def op11(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Lloyd's rounds one after the other: a table of assignments and one of centroids for each."""
    apart = "CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS HUGEINT))) AS BIGINT)"
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT n AS cluster, x FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS n, x FROM v WHERE vec_id IS NOT NULL) WHERE n < {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT rid, cluster, distance FROM (
    SELECT v.rid, c.cluster, {apart} AS distance, row_number() OVER (PARTITION BY v.rid ORDER BY {apart}, c.cluster) AS place FROM v CROSS JOIN c{i} c) WHERE place = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS x FROM (
      SELECT cluster, d, CAST(sum(x[d]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (rid), range(1, {dims + 1}) r(d) GROUP BY cluster, d) GROUP BY cluster) m USING (cluster))""")
    own = f"SELECT v.vec_id, a.cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster) AS ci, sum(a.distance) OVER () AS i, c.x FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.cluster = a.cluster"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(ci AS BIGINT) AS cluster_inertia, CAST(i AS BIGINT) AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM ({own})"""
