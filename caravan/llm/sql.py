"""DuckDB texts of the registered queries that SQL can express."""

LINE_DEDUP = r"""
WITH line AS (
  SELECT doc_id, source, text, i,
         string_split(text, chr(10))[i] AS line,
         trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS key
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
  WHERE text IS NOT NULL
),
host AS (SELECT source, CAST(count(DISTINCT text) AS DOUBLE) AS total FROM documents GROUP BY source),
-- lines of more than 5 % of a source's distinct texts: 2 standard deviations above
vote AS (
  SELECT l.source, l.key
  FROM (SELECT DISTINCT source, text, key FROM line WHERE key <> '') l
  JOIN host h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.key, h.total
  HAVING count(*) >= 2 AND count(*) - h.total * CAST(0.05 AS DOUBLE) > 0
    AND (count(*) - h.total * CAST(0.05 AS DOUBLE)) * (count(*) - h.total * CAST(0.05 AS DOUBLE))
        > h.total * (CAST(4 AS DOUBLE) * CAST(0.05 AS DOUBLE) * (1 - CAST(0.05 AS DOUBLE)))
),
-- texts that hold such lines beside as much other text
page AS (
  SELECT l.source, l.text
  FROM (SELECT source, text, i, any_value(key) AS key FROM line GROUP BY source, text, i) l
  LEFT JOIN vote v ON l.source IS NOT DISTINCT FROM v.source AND l.key = v.key
  GROUP BY l.source, l.text
  HAVING 2 * sum(CASE WHEN v.key IS NOT NULL THEN length(l.key) ELSE 0 END) <= sum(length(l.key))
),
boiler AS (
  SELECT l.source, l.key
  FROM (SELECT DISTINCT source, text, key FROM line WHERE key <> '') l
  JOIN vote v ON l.source IS NOT DISTINCT FROM v.source AND l.key = v.key
  JOIN page p ON l.source IS NOT DISTINCT FROM p.source AND l.text = p.text
  JOIN host h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.key, h.total
  HAVING count(*) >= 2 AND count(*) - h.total * CAST(0.05 AS DOUBLE) > 0
    AND (count(*) - h.total * CAST(0.05 AS DOUBLE)) * (count(*) - h.total * CAST(0.05 AS DOUBLE))
        > h.total * (CAST(4 AS DOUBLE) * CAST(0.05 AS DOUBLE) * (1 - CAST(0.05 AS DOUBLE)))
),
marked AS (
  SELECT l.doc_id, l.i, l.line, b.key IS NOT NULL AS cut
  FROM line l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.key = b.key
),
cleaned AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '') AS text,
         count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_dropped
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, d.source, c.text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id
"""

EXACT_DEDUP = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

MIXING = r"""
WITH doc AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM doc GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS w
  FROM src
),
-- sources in the order in which they reach their cap as the level rises
ordered AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS capped,
         sum(w) OVER (ORDER BY cap / w, w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_w,
         sum(source_size) OVER () AS total
  FROM weighed
),
level AS (
  SELECT max(CAST(total - capped AS DOUBLE) / CAST(free_w AS DOUBLE)) AS lv
  FROM ordered
),
target AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), lv * w) AS target,
         CASE WHEN source_size > 0 THEN least(CAST(cap AS DOUBLE), lv * w) / source_size ELSE 0 END AS rate
  FROM weighed, level
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       d.size * CAST(floor(t.rate) + CASE WHEN
           CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)
             / 4503599627370496.0 < t.rate - floor(t.rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM doc d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
"""

TOP_K = """
WITH vec AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM vec q JOIN vec d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

JACCARD_JOIN = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) END AS s
  FROM word
),
gram AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common, any_value(a.n) AS n, any_value(b.n) AS m
  FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id
),
link AS (
  SELECT x, y FROM pair WHERE 100 * common >= 90 * (n + m - common)
  UNION ALL
  SELECT y, x FROM pair WHERE 100 * common >= 90 * (n + m - common)
),
reach AS (
  SELECT doc_id, doc_id AS to_id FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN link l ON r.to_id = l.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.to_id) AS component_id
FROM sets s JOIN reach r ON r.doc_id = s.doc_id
GROUP BY s.doc_id, len(s.s)
"""

HARD_NEGATIVES = """
WITH vec AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same,
         CAST(list_dot_product(a.v, d.v) AS BIGINT) AS score
  FROM vec a JOIN vec d ON a.vec_id % 100 = 0 AND a.vec_id <> d.vec_id
),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

PERIODIC_RUNS = r"""
WITH crc AS (  -- crc32 of the id's decimal digits, bit by bit
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
               [CAST(ascii(c) AS BIGINT) for c in string_split(CAST(doc_id AS VARCHAR), '')]),
             lambda s, b: list_reduce(list_concat([xor(s, b)], [CAST(k AS BIGINT) for k in range(8)]),
               lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, CAST(3988292384 AS BIGINT)) ELSE t >> 1 END)),
             CAST(4294967295 AS BIGINT)) AS h
  FROM documents
),
place AS (
  SELECT rid, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, (h // 10) AS g
  FROM crc
),
doc AS (
  SELECT rid, doc_id, n,
         CASE WHEN planted THEN [CASE WHEN i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE w[i + 1] END
                                 for i in range(n)] ELSE w END AS w
  FROM place
),
word AS (SELECT rid, n, unnest(w) AS w, unnest(range(n)) AS i FROM doc),
-- places i whose word stands q places later too
equal AS (
  SELECT x.rid, x.i, y.i - x.i AS q
  FROM word x JOIN word y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
),
stretch AS (
  SELECT rid, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM equal)
  GROUP BY rid, q, island
  HAVING count(*) + q >= greatest(6, 4 * q)
),
run AS (SELECT rid, start, length, min(q) AS period FROM stretch GROUP BY rid, start, length),
listed AS (
  SELECT rid, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM run GROUP BY rid
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM run
),
kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY i) AS collapsed
  FROM word x
  WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.rid = x.rid AND x.i >= r.start + r.period AND x.i < r.start + r.length)
  GROUP BY rid
)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period,
       CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.collapsed, '')) AS collapsed_sha256
FROM doc d LEFT JOIN listed l ON d.rid = l.rid LEFT JOIN best b ON d.rid = b.rid AND b.place = 1
     LEFT JOIN kept k ON d.rid = k.rid
"""
