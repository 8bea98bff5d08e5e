"""DuckDB SQL that must give what the queries of this subpackage give."""

_SHINGLES = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE body IS NOT NULL
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {last}], ' ') AS s
  FROM worded, LATERAL (SELECT unnest(range(1, len(w) - {last} + 1)) AS i) WHERE len(w) >= {words}
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1
), shared AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
)"""

_TAGS = """
WITH tagged AS (SELECT DISTINCT document, lower(name) AS tag FROM document_tags WHERE name IS NOT NULL),
n AS (SELECT tag, count(*) AS n FROM tagged GROUP BY 1),
total AS (SELECT count(DISTINCT document) AS docs FROM document_tags),
pair AS (
  SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS together FROM tagged a JOIN tagged b ON a.document = b.document AND a.tag < b.tag GROUP BY 1, 2
), counted AS (
  SELECT tag_a, tag_b, together, x.n AS n_a, y.n AS n_b, docs FROM pair JOIN n x ON x.tag = tag_a JOIN n y ON y.tag = tag_b, total
)"""

_VECTORS = """
WITH v AS (
  SELECT DISTINCT document, model_id, dimensions, embedding::DOUBLE[] AS e FROM document_vectors
  WHERE embedding IS NOT NULL AND len(embedding) = dimensions AND dimensions > 0
    AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x) OR x IS NULL)) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.model_id, a.dimensions, a.document AS d, b.document AS o, round(max(list_cosine_similarity(a.e, b.e)), 12) AS c
  FROM v a JOIN v b ON a.model_id = b.model_id AND a.dimensions = b.dimensions AND a.document <> b.document GROUP BY 1, 2, 3, 4
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model_id, dimensions, d ORDER BY c DESC, o) AS n FROM near
)"""

# Every body: those of three words or more by their shingles, shorter ones by equal words or, without a word, by the unchanged text.
_CLASSED = _SHINGLES + """, pair AS (SELECT doc_a, doc_b, c, x.n AS n_a, y.n AS n_b FROM shared JOIN size x ON x.doc_id = doc_a JOIN size y ON y.doc_id = doc_b WHERE c / (x.n + y.n - c) >= {least}),
edge AS (SELECT doc_a AS a, doc_b AS b FROM pair UNION ALL SELECT doc_b, doc_a FROM pair),
reach AS (SELECT doc_id, doc_id AS other FROM size UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other),
shingled AS (
  SELECT s.doc_id, least(s.doc_id, (SELECT min(doc_a) FROM pair WHERE doc_b = s.doc_id AND c = n_a AND c = n_b)) AS class_id, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS group_id,
    (SELECT count(*) FROM edge WHERE a = s.doc_id) AS links FROM size s
), short AS (
  SELECT d.doc_id, CASE WHEN len(w) > 0 THEN 'w' || array_to_string(w, ' ') ELSE 't' || body END AS alike FROM documents d JOIN worded USING (doc_id) WHERE len(w) < {words}
), held AS (SELECT alike, min(doc_id) AS class_id, count(*) - 1 AS links FROM short GROUP BY 1)
SELECT * FROM shingled UNION ALL SELECT doc_id, class_id, class_id, links FROM short JOIN held USING (alike) UNION ALL SELECT doc_id, doc_id, doc_id, 0 FROM documents WHERE body IS NULL"""

ORACLES = {
    "p2_neighbours": _VECTORS + " SELECT model_id, dimensions, d AS document, n AS rank, o AS other, round(c, 9) AS cosine FROM ranked WHERE n <= 5 AND d % 50 = 0",
    "p3_pairs": _TAGS + " SELECT tag_a, tag_b, together, n_a, n_b, round(together * docs / (n_a * n_b), 6) AS lift FROM counted",
    "p4_covered": "SELECT doc_id, strlen(body) AS bytes, true AS short, true AS joined, true AS laps, true AS own FROM documents WHERE strlen(body) > 2000",
    "p6_documents": _CLASSED.format(last=2, words=3, least=0.7),
    "p6_strict_documents": _CLASSED.format(last=4, words=5, least=0.8),
    "p8_limits": "SELECT unnest(['tokens', 'segments', 'loss', 'overlapping', 'lost', 'cut', 'documents']) AS broken, unnest([0, 0, 0, 0, 0, 0, (SELECT count(*) FROM documents)]) AS cases",
    "p2_found": _VECTORS + " SELECT DISTINCT model_id, dimensions, least(d, o) AS doc_a, greatest(d, o) AS doc_b FROM ranked WHERE n <= 5 AND c >= 0.9",
    "p6_groups": _SHINGLES.format(last=2, words=50) + """, pair AS (SELECT doc_a, doc_b, c, x.n AS n_a, y.n AS n_b FROM shared JOIN size x ON x.doc_id = doc_a JOIN size y ON y.doc_id = doc_b WHERE c / (x.n + y.n - c) >= 0.7),
edge AS (SELECT doc_a AS a, doc_b AS b FROM pair UNION ALL SELECT doc_b, doc_a FROM pair),
reach AS (SELECT doc_id, doc_id AS other FROM size UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT s.doc_id, least(s.doc_id, (SELECT min(doc_a) FROM pair WHERE doc_b = s.doc_id AND c = n_a AND c = n_b)) AS class_id, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS group_id FROM size s""",
    "p3_found": _TAGS + " SELECT tag_a, tag_b FROM counted WHERE together >= 5 AND together * docs >= 4 * n_a * n_b",
    "p3_counts": _TAGS + " SELECT tag_a, tag_b, together, n_a, n_b, round(together * docs / (n_a * n_b), 6) AS lift FROM counted WHERE together >= 2",
    "p6_found": _SHINGLES.format(last=2, words=50) + " SELECT doc_a, doc_b FROM shared JOIN size x ON x.doc_id = doc_a JOIN size y ON y.doc_id = doc_b WHERE c / (x.n + y.n - c) >= 0.7",
    "p6_strict": _SHINGLES.format(last=4, words=5) + """, pair AS (SELECT doc_a, doc_b, c, x.n AS n_a, y.n AS n_b FROM shared JOIN size x ON x.doc_id = doc_a JOIN size y ON y.doc_id = doc_b),
copies AS (SELECT doc_b FROM pair WHERE c = n_a AND c = n_b)
SELECT doc_a, doc_b, round(c / (n_a + n_b - c), 6) AS similarity FROM pair
WHERE c / (n_a + n_b - c) >= 0.8 AND doc_a NOT IN (SELECT doc_b FROM copies) AND doc_b NOT IN (SELECT doc_b FROM copies)""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
