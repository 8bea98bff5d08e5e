"""Queries of the find, count and describe surface (inventory F, A, O), with the SQL that must agree."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.functions import parse
from vaultframe.operators import aggregates, predicates as P, projection, reads, resolve
from vaultframe.queries.problems import _P5
from vaultframe.session import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _find(make):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        predicate: Column = make()
        return _docs(spark, sf).filter(predicate).select("path")

    return query


_J = "(json_extract(frontmatter, '$.\"{0}\"'))"
_S = "(frontmatter ->> '$.\"{0}\"')"
_DAY = "TRY_CAST(nullif(regexp_extract(" + _S + ", '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})($|[T ])', 1), '') AS DATE)"
_STRINGS = "(CASE json_type({j}) WHEN 'VARCHAR' THEN [{s}] WHEN 'ARRAY' THEN CAST({j} AS VARCHAR[]) ELSE CAST([] AS VARCHAR[]) END)"


def _any(field: str, test: str) -> str:
    return f"len(list_filter({_STRINGS.format(j=_J.format(field), s=_S.format(field))}, lambda x: {test})) > 0"


# name: (predicate, the SQL condition that must agree)
_FINDS = {
    "f01_text": (lambda: P.text("THE MOSS"), "contains(lower(body), 'the moss')"),
    "f02_eq": (lambda: P.eq("type", "task"), f"{_S.format('type')} = 'task' AND json_type({_J.format('type')}) = 'VARCHAR'"),
    "f02_eq_number": (lambda: P.eq("weight", 2), f"{_J.format('weight')}::VARCHAR = '2'"),
    "f03_not_eq": (lambda: P.not_eq("type", "task"), f"NOT coalesce({_S.format('type')} = 'task', false)"),
    "f04_in": (lambda: P.any_of("type", ["task", "note"]), f"{_S.format('type')} IN ('task', 'note')"),
    "f05_not_in": (lambda: P.none_of("type", ["task", "note"]), f"NOT coalesce({_S.format('type')} IN ('task', 'note'), false)"),
    "f06_starts_with": (lambda: P.starts_with("tags", "area/"), _any("tags", "starts_with(x, 'area/')")),
    "f07_ends_with": (lambda: P.ends_with("tags", "-watch"), _any("tags", "ends_with(x, '-watch')")),
    "f08_contains": (lambda: P.contains("related", "house"), _any("related", "contains(x, 'house')")),
    "f09_has": (lambda: P.has("project"), f"{_S.format('project')} IS NOT NULL"),
    "f10_missing": (lambda: P.missing("project"), f"{_S.format('project')} IS NULL"),
    "f11_before": (lambda: P.before("created", "2024-06-01"), f"{_DAY.format('created')} < DATE '2024-06-01'"),
    "f12_after": (lambda: P.after("created", "2025-06-01"), f"{_DAY.format('created')} > DATE '2025-06-01'"),
    "f13_on": (lambda: P.on("due", "2025-03-01"), f"{_DAY.format('due')} = DATE '2025-03-01'"),
    "f14_glob": (lambda: P.path_glob("**/notes/*.md"), r"regexp_matches(path, '^(.*/)?notes/[^/]*\.md$')"),
    "f17_combined": (lambda: P.eq("type", "task") & P.has("created") & P.path_glob("delta-*/**"), f"{_S.format('type')} = 'task' AND {_S.format('created')} IS NOT NULL AND regexp_matches(path, '^delta-[^/]*/.*$')"),
}


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Links, documents, headings and the block ids that links may ask for."""
    docs = _docs(spark, sf)
    return table(spark, sf, "links"), docs, table(spark, sf, "headings"), parse.block_ids(docs, "doc_id", "text")


def f15_links_to(spark, sf):
    """Documents with a link, of either family, that resolves to the document most linked to."""
    links, docs, _, _ = _parts(spark, sf)
    single = resolve.naming(links, docs).groupBy("document", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    most = single.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).join(docs.select("doc_id", "path"), "doc_id").orderBy(F.desc("n"), "doc_id").limit(1).first()
    hit = resolve.links_to(links, docs, [most["path"]]) if most else docs.select("doc_id").filter("false")
    return docs.select("doc_id", "path").join(hit, "doc_id", "left_semi").select("path")


def f16_unresolved(spark, sf):
    """Documents with a link, of either family, that resolves to no one document, or whose anchor or block is not there."""
    links, docs, heads, blocks = _parts(spark, sf)
    lost = resolve.outcomes(links, docs, heads, blocks).filter("reason is not null").select(F.col("document").alias("doc_id"))
    return docs.select("doc_id", "path").join(lost, "doc_id", "left_semi").select("path")


def x14_unresolved(spark, sf):
    """How links resolve: counts by family and reason."""
    links, docs, heads, blocks = _parts(spark, sf)
    out = resolve.outcomes(links, docs, heads, blocks).join(resolve.plain(links, "true", "family"), ["document", "ordinal"])
    return out.groupBy("family", F.coalesce("reason", F.lit("resolved")).alias("reason")).agg(F.count(F.lit(1)).alias("links"))


def f18_projection(spark, sf):
    links, docs, heads, blocks = _parts(spark, sf)
    df, unknown = projection.project(docs, ["type", "title", ".path", ".stem", ".document_hash", ".headings", ".outgoing_links", ".unresolved_links", ".incoming_links", ".nope"], links, heads, blocks)
    assert unknown == [".nope"]
    return df.select("type", "title", *[(F.array_join(f"`{c}`", "|") if c in (".headings", ".outgoing_links", ".unresolved_links", ".incoming_links") else F.col(f"`{c}`")).alias(c[1:]) for c in df.columns if c[0] == "."])


def a01_count(spark, sf):
    return _docs(spark, sf).filter(P.eq("type", "task")).agg(F.count(F.lit(1)).alias("total"))


def a02_count_by(spark, sf):
    return aggregates.count_by(_docs(spark, sf), "type")


def a03_count_by_multi(spark, sf):
    return aggregates.count_by(_docs(spark, sf), "type", "kind", "project")


def a04_distribution(spark, sf):
    return aggregates.distribution(_docs(spark, sf))


def a05_describe(spark, sf):
    return aggregates.describe(_docs(spark, sf)).select("field", "present", "distinct_values", "unique_like", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"))


RULES = {"tasks": "**/tasks/**", "notes": "**/notes/*.md", "delta": "delta-*/**"}


def a07_structure(spark, sf):
    return aggregates.structure(_docs(spark, sf), RULES)


def a09_distinct(spark, sf):
    return table(spark, sf, "document_tags").select(F.lower("name").alias("name"), "source").distinct()


def a11_tag_stats(spark, sf):
    return table(spark, sf, "document_tags").groupBy("name").agg(F.count_distinct("document").alias("documents"), F.count(F.lit(1)).alias("occurrences"))


def o01_sort(spark, sf):
    return _docs(spark, sf).select("path", P.raw("created").alias("created")).orderBy(F.col("created").desc_nulls_last(), "path").limit(50)


def o02_offset(spark, sf):
    return _docs(spark, sf).select("path", "byte_length").orderBy(F.desc("byte_length"), "path").offset(20).limit(30)


def o03_drain(spark, sf):
    """The first pages of the path order by keyset steps, each from the last one's key, with their numbers."""
    rows = [(n, r["path"]) for n, page in enumerate(islice(reads.drain(_docs(spark, sf).select("path"), "path", 150), 4)) for r in page]
    return spark.createDataFrame(rows, "page int, path string")


def u01_union(spark, sf):
    """Documents tagged in the body or in the frontmatter: each once."""
    t = table(spark, sf, "document_tags").filter("lower(name) = 'status/active'")
    return t.filter("source = 'body'").select("document").unionByName(t.filter("source = 'frontmatter'").select("document")).distinct()


_LEAF = "string_split(path, '/')[-1]"
_FIELDS = "fields AS (SELECT path, k AS field, frontmatter ->> ('$.\"' || k || '\"') AS value FROM (SELECT path, frontmatter, unnest(json_keys(frontmatter)) AS k FROM documents WHERE frontmatter IS NOT NULL))"
_MISS = "coalesce({0}, '(missing)')"

OUTCOMES = _P5 + r""", blocks AS (SELECT doc_id, unnest(regexp_extract_all(body, '(?m)(?:^|\s)\^([A-Za-z0-9_-]+)[ \t]*$', 1)) AS block FROM documents),
asked AS (SELECT DISTINCT document, ordinal, block_ref FROM links WHERE protocol IS NULL AND block_ref IS NOT NULL),
counted AS (SELECT document, ordinal, count(DISTINCT doc_id) AS n FROM hits GROUP BY 1, 2),
outcome AS (
  SELECT n.document, n.ordinal, n.family, CASE WHEN c.n IS NULL THEN 'target-missing' WHEN c.n > 1 THEN 'ambiguous' WHEN n.anchor IS NOT NULL AND (n.document, n.ordinal) NOT IN (SELECT (document, ordinal) FROM anchored) THEN 'anchor-missing'
    WHEN a.block_ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hits h JOIN blocks b ON b.doc_id = h.doc_id AND b.block = a.block_ref WHERE h.document = n.document AND h.ordinal = n.ordinal) THEN 'block-ref-missing' END AS reason
  FROM named n LEFT JOIN counted c ON c.document = n.document AND c.ordinal = n.ordinal LEFT JOIN asked a ON a.document = n.document AND a.ordinal = n.ordinal
)"""

ORACLES = {
    **{k: f"SELECT path FROM documents WHERE {sql}" for k, (_, sql) in _FINDS.items()},
    "f15_links_to": _P5 + ", one AS (SELECT document, ordinal, min(doc_id) AS there FROM hits GROUP BY 1, 2 HAVING count(DISTINCT doc_id) = 1), t AS (SELECT there FROM one GROUP BY 1 ORDER BY count(*) DESC, there LIMIT 1) SELECT path FROM documents WHERE doc_id IN (SELECT document FROM one JOIN t USING (there))",
    "f16_unresolved": OUTCOMES + " SELECT path FROM documents WHERE doc_id IN (SELECT document FROM outcome WHERE reason IS NOT NULL)",
    "x14_unresolved": OUTCOMES + " SELECT family, coalesce(reason, 'resolved') AS reason, count(*) AS links FROM outcome GROUP BY 1, 2",
    "f18_projection": OUTCOMES + rf""", tgt AS (SELECT DISTINCT document, ordinal, target FROM links), one AS (SELECT document, ordinal, min(doc_id) AS there FROM hits GROUP BY 1, 2 HAVING count(DISTINCT doc_id) = 1)
SELECT {_S.format('type')} AS type, {_S.format('title')} AS title, path, regexp_replace({_LEAF}, '^(.+)\.[^.]*$', '\1') AS stem, content_hash AS document_hash,
  coalesce((SELECT string_agg(text, '|' ORDER BY ordinal) FROM (SELECT DISTINCT ordinal, text FROM headings WHERE document = d.doc_id)), '') AS headings,
  coalesce((SELECT string_agg(target, '|' ORDER BY ordinal) FROM tgt WHERE document = d.doc_id), '') AS outgoing_links,
  coalesce((SELECT string_agg(target, '|' ORDER BY t.ordinal) FROM tgt t JOIN outcome o ON o.document = t.document AND o.ordinal = t.ordinal WHERE t.document = d.doc_id AND reason IS NOT NULL), '') AS unresolved_links,
  coalesce((SELECT string_agg(path, '|' ORDER BY path) FROM (SELECT DISTINCT h.path FROM one JOIN documents h ON h.doc_id = one.document WHERE there = d.doc_id AND one.document <> d.doc_id)), '') AS incoming_links
FROM documents d""",
    "a01_count": f"SELECT count(*) AS total FROM documents WHERE {_S.format('type')} = 'task'",
    "a02_count_by": f"SELECT {_MISS.format(_S.format('type'))} AS type, count(*) AS documents FROM documents GROUP BY 1",
    "a03_count_by_multi": f"SELECT {_MISS.format(_S.format('type'))} AS type, {_MISS.format(_S.format('kind'))} AS kind, {_MISS.format(_S.format('project'))} AS project, count(*) AS documents FROM documents GROUP BY 1, 2, 3",
    "a04_distribution": f"WITH {_FIELDS} SELECT field, value, count(*) AS documents FROM fields GROUP BY 1, 2",
    "a05_describe": f"WITH {_FIELDS}, d AS (SELECT *, TRY_CAST(nullif(regexp_extract(value, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})($|[T ])', 1), '') AS DATE) AS day FROM fields) SELECT field, count(value) AS present, count(DISTINCT value) AS distinct_values, count(value) > 0 AND count(value) = count(DISTINCT value) AS unique_like, min(day)::VARCHAR AS first_date, max(day)::VARCHAR AS last_date FROM d GROUP BY 1",
    "a07_structure": r"""
WITH r AS (SELECT path, rule FROM documents, (VALUES ('tasks', '^(.*/)?tasks/.*$'), ('notes', '^(.*/)?notes/[^/]*\.md$'), ('delta', '^delta-[^/]*/.*$')) t(rule, pattern) WHERE regexp_matches(path, pattern))
SELECT 'folder' AS facet, array_to_string(segs[1:i], '/') AS name, count(*) AS documents FROM (SELECT string_split(path, '/') AS segs FROM documents), LATERAL (SELECT unnest(range(1, len(segs))) AS i) GROUP BY 1, 2
UNION ALL SELECT 'rule', rule, count(*) FROM r GROUP BY 1, 2 UNION ALL SELECT 'unruled', '', count(*) FROM documents WHERE path NOT IN (SELECT path FROM r) UNION ALL SELECT 'total', '', count(*) FROM documents""",
    "a09_distinct": "SELECT DISTINCT lower(name) AS name, source FROM document_tags",
    "a11_tag_stats": "SELECT name, count(DISTINCT document) AS documents, count(*) AS occurrences FROM document_tags GROUP BY 1",
    "o01_sort": f"SELECT path, {_S.format('created')} AS created FROM documents ORDER BY created DESC NULLS LAST, path LIMIT 50",
    "o02_offset": "SELECT path, byte_length FROM documents ORDER BY byte_length DESC, path LIMIT 30 OFFSET 20",
    "o03_drain": "SELECT ((n - 1) // 150)::INT AS page, path FROM (SELECT path, row_number() OVER (ORDER BY path) AS n FROM documents) WHERE n <= 600",
    "u01_union": "SELECT document FROM document_tags WHERE lower(name) = 'status/active' AND source = 'body' UNION SELECT document FROM document_tags WHERE lower(name) = 'status/active' AND source = 'frontmatter'",
}

QUERIES = {k: _find(_FINDS[k][0]) if k in _FINDS else globals()[k] for k in ORACLES}
