"""SQL for the operators whose results SQL can express from their definition, without any index."""

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: array_to_string(list_slice(words, i, i + 2), ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.size + y.size - k)),
link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT r.doc_id, CAST(coalesce(any_value(n.size), 0) AS BIGINT) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS h FROM p),
d AS (SELECT doc_id, i FROM k JOIN (SELECT h, min(doc_id) AS least FROM k GROUP BY 1) USING (h) WHERE doc_id > least),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS fresh FROM d)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS x, a - 1 AS y, b - a AS gone FROM spans
  UNION ALL SELECT w.doc_id, coalesce(max(b), 1), len(any_value(words)), 0 FROM w LEFT JOIN spans ON spans.doc_id = w.doc_id GROUP BY w.doc_id),
cut AS (SELECT w.doc_id, len(words) AS n, gone, x, CASE WHEN y >= x THEN list_slice(words, x, y) ELSE [] END AS part FROM w JOIN pieces ON pieces.doc_id = w.doc_id)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, sha256(array_to_string(flatten(list(part ORDER BY x)), ' ')) AS kept_sha256 FROM cut GROUP BY doc_id
"""

SUFFIXES = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM t WHERE length(h) >= 200),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS m FROM p),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS nth FROM k) WHERE nth > 1),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM d)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y, b - a AS gone, 1 AS one FROM spans
  UNION ALL SELECT t.doc_id, coalesce(max(b), 0), length(any_value(h)) // 2, 0, 0 FROM t LEFT JOIN spans ON spans.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT t.doc_id, CAST(any_value(length(h) // 2) AS BIGINT) AS n_bytes, CAST(sum(gone) AS BIGINT) AS n_removed, CAST(sum(one) AS BIGINT) AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x))) AS kept_sha256
FROM t JOIN pieces ON pieces.doc_id = t.doc_id GROUP BY t.doc_id
"""
