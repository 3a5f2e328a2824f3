"""DuckDB SQL for the operators that SQL can express on whole tables."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op9_exact_topk"] = """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM fit q JOIN fit c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL["op7_decontamination"] = f"""
WITH item AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_SMALL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), phrase AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_SMALL}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), place AS (
  SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM phrase) WHERE len(w) >= size
), hit AS (
  SELECT place.r, place.i, place.size, phrase.item_id FROM (SELECT *, array_to_string(list_slice(w, i, i + size - 1), ' ') AS p FROM place) place JOIN phrase USING (size, p)
), words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def _op11() -> str:
    """The rounds one after another, every vector against every centroid."""
    near = """SELECT id, v, cluster, d FROM (
    SELECT f.id, f.v, c.n AS cluster,
           list_sum(list_transform(list_zip(f.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM fit f, {c} c
  ) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1"""
    parts = [
        """fit AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v
  FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM fit WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 40)
)""",
    ]
    for r in range(5):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.n, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT cluster, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY i) AS v
    FROM (SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS k FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY cluster, i)
    GROUP BY cluster
  ) m ON m.cluster = c.n
)""")
    parts.append(f"a5 AS MATERIALIZED ({near.format(c='c5')})")
    return f"""WITH {', '.join(parts)}
SELECT fit.vec_id, a5.cluster::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a5.cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM a5 JOIN fit USING (id) JOIN c5 ON c5.n = a5.cluster"""


ORACLE_SQL["op11_annulus_clusters"] = _op11()

# equal words at distance q; a stretch of them in a row is a run, and of equal stretches the smallest q is the period
def _crc_step(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


_TABLE = ", ".join(f"{_crc_step(i)}::UBIGINT" for i in range(256))
_WORDS = "[^\\x20\\x09-\\x0D]+"

ORACLE_SQL["op13_word_runs"] = f"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w0,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda ch: ord(ch)::UBIGINT)),
        lambda c, b: xor(c >> 8, [{_TABLE}][(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) AS h
  FROM documents
), sized AS (
  SELECT *, len(w0) AS n, (h // 10)::BIGINT AS g FROM doc
), placed AS (
  SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM sized
), looped AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w0 END AS w
  FROM placed
), word AS MATERIALIZED (
  SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM looped
), pair AS (
  SELECT p.r, p.i, s.i - p.i AS q FROM word p JOIN word s ON p.r = s.r AND p.x = s.x AND s.i > p.i AND 2 * (s.i - p.i) <= p.n
), island AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT r, i, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM pair) GROUP BY r, q, g HAVING count(*) + q >= greatest(12, 2 * q)
), runs AS MATERIALIZED (
  SELECT r, start, length, min(q) AS period FROM island GROUP BY r, start, length
), per AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period) AS best
  FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT word.r, string_agg(x, ' ' ORDER BY word.i) AS t FROM word ANTI JOIN gone ON word.r = gone.r AND word.i = gone.i GROUP BY word.r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
       (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM looped LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""
