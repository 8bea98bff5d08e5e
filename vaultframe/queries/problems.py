"""Queries of the general problems: nested records (1) and orphan references (5), with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vaultframe.operators import orphans, shred
from vaultframe.session import materialize, table


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return shred.shred(table(spark, sf, "documents"), "doc_id", "frontmatter")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return shred.objects(_levels(spark, sf)).withColumnRenamed("record", "doc_id")


def p1_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).withColumnRenamed("record", "doc_id")


def p1_cells(spark: SparkSession, sf: str) -> DataFrame:
    return shred.cells(_levels(spark, sf)).withColumnRenamed("record", "doc_id")


def p1_tasks(spark: SparkSession, sf: str) -> DataFrame:
    cell = shred.cells(_levels(spark, sf))
    return shred.flat_table(cell, "/tasks/~", ["name", "state", "due"]).withColumnRenamed("record", "doc_id")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_links(table(spark, sf, "links"), table(spark, sf, "documents"), table(spark, sf, "headings"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(materialize(_orphans(spark, sf), "orphans"), table(spark, sf, "documents"))


_P1_WALK = """
WITH RECURSIVE walk AS (
  SELECT doc_id, '' AS node, '' AS encloses, frontmatter::JSON AS j, json_type(frontmatter) AS kind
  FROM documents WHERE frontmatter IS NOT NULL
  UNION ALL
  SELECT w.doc_id, w.node || '/' || replace(replace(e.key, '~', '~0'), '/', '~1'), CASE WHEN w.kind = 'OBJECT' THEN w.node ELSE w.encloses END, e.value, json_type(e.value)
  FROM walk w, json_each(w.j) e WHERE w.kind IN ('OBJECT', 'ARRAY')
)"""

_P5 = r"""
WITH live AS (
  SELECT DISTINCT l.document, l.ordinal, l.family, l.target, l.anchor, d.path AS home
  FROM links l LEFT JOIN documents d ON d.doc_id = l.document WHERE l.protocol IS NULL
), parted AS (
  SELECT *, list_concat([CASE WHEN starts_with(target, '/') OR home NOT LIKE '%/%' THEN '' ELSE regexp_replace(home, '/[^/]*$', '') END], string_split(target, '/')) AS parts FROM live
), named AS (
  SELECT document, ordinal, family, target, anchor, home,
    list_reduce(parts, lambda acc, s: CASE WHEN acc = chr(1) OR s = '.' OR s = '' THEN acc WHEN s = '..' THEN CASE WHEN acc = '' THEN chr(1) WHEN acc LIKE '%/%' THEN regexp_replace(acc, '/[^/]*$', '') ELSE '' END WHEN acc = '' THEN s ELSE acc || '/' || s END) AS there
  FROM parted
), suffix AS (
  SELECT doc_id, array_to_string(segs[i:], '/') AS called
  FROM (SELECT doc_id, string_split(regexp_replace(path, '^(.*[^/])\.[^./]*$', '\1'), '/') AS segs FROM documents), LATERAL (SELECT unnest(range(1, len(segs) + 1)) AS i)
), hits AS (
  SELECT n.document, n.ordinal, s.doc_id FROM named n JOIN suffix s ON s.called = n.target WHERE family = 'wikilink' AND target <> ''
  UNION SELECT n.document, n.ordinal, s.doc_id FROM named n JOIN suffix s ON s.called = regexp_replace(n.target, '^(.*[^/])\.[^./]*$', '\1') WHERE family = 'wikilink' AND target <> ''
  UNION SELECT n.document, n.ordinal, d.doc_id FROM named n JOIN documents d ON d.path = n.there WHERE family = 'markdown' AND target <> ''
  UNION SELECT n.document, n.ordinal, d.doc_id FROM named n JOIN documents d ON d.doc_id = n.document WHERE target = ''
), anchored AS (
  SELECT DISTINCT h.document, h.ordinal FROM hits h JOIN named n ON n.document = h.document AND n.ordinal = h.ordinal
  JOIN headings g ON g.document = h.doc_id AND n.anchor = CASE WHEN n.family = 'wikilink' THEN g.text ELSE g.slug END
), orphan AS (
  SELECT n.document, n.ordinal,
    CASE WHEN (n.document, n.ordinal) NOT IN (SELECT (document, ordinal) FROM hits) THEN 'documents'
         WHEN n.anchor IS NOT NULL AND (n.document, n.ordinal) NOT IN (SELECT (document, ordinal) FROM anchored) THEN 'headings' END AS missing_in
  FROM named n
)"""

QUERIES = {"p1_found": p1_found, "p1_levels": p1_levels, "p1_cells": p1_cells, "p1_tasks": p1_tasks, "p5_found": p5_found, "p5_report": p5_report}

_P1_CELLS = """
WITH RECURSIVE walk AS (
  SELECT doc_id, '' AS tbl, '' AS node, '' AS parent, '' AS parent_table, '' AS col, frontmatter::JSON AS j, json_type(frontmatter) AS kind FROM documents WHERE frontmatter IS NOT NULL
  UNION ALL
  SELECT w.doc_id, CASE WHEN w.kind = 'ARRAY' THEN w.tbl || CASE WHEN w.col = '' THEN '' ELSE '/' || w.col END || '/~' ELSE w.tbl END, CASE WHEN w.kind = 'ARRAY' THEN w.node || CASE WHEN w.col = '' THEN '' ELSE '/' || w.col END || '/' || e.key ELSE w.node END,
    CASE WHEN w.kind = 'ARRAY' THEN w.node ELSE w.parent END, CASE WHEN w.kind = 'ARRAY' THEN w.tbl ELSE w.parent_table END,
    CASE WHEN w.kind = 'ARRAY' THEN '' ELSE CASE WHEN w.col = '' THEN '' ELSE w.col || '/' END || replace(replace(e.key, '~', '~0'), '/', '~1') END, e.value, json_type(e.value)
  FROM walk w, json_each(w.j) e WHERE w.kind IN ('OBJECT', 'ARRAY')
)"""

ORACLES = {
    "p1_cells": _P1_CELLS + " SELECT doc_id, tbl AS \"table\", node, parent, parent_table, col AS \"column\", j::VARCHAR AS value FROM walk WHERE kind NOT IN ('OBJECT', 'ARRAY') OR j::VARCHAR IN ('{}', '[]')",
    "p1_found": _P1_WALK + " SELECT doc_id, node, encloses AS parent FROM walk WHERE kind = 'OBJECT' AND node <> ''",
    "p1_tasks": """
SELECT doc_id, '/tasks/' || (i - 1) AS node, '' AS parent, json_extract(t, '$.name')::VARCHAR AS name, json_extract(t, '$.state')::VARCHAR AS state, json_extract(t, '$.due')::VARCHAR AS due
FROM (SELECT doc_id, ts[i] AS t, i FROM (SELECT doc_id, json_extract(frontmatter, '$.tasks[*]') AS ts FROM documents), LATERAL (SELECT unnest(range(1, len(ts) + 1)) AS i))
WHERE json_type(t) NOT IN ('OBJECT', 'ARRAY') OR json(t) = '{}' OR json_type(t) = 'OBJECT'""",
    "p5_found": _P5 + " SELECT document, ordinal, missing_in FROM orphan WHERE missing_in IS NOT NULL",
    "p5_report": _P5 + " SELECT missing_in, strftime(to_timestamp(d.derived_at) AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS orphans FROM orphan o LEFT JOIN documents d ON d.doc_id = o.document WHERE missing_in IS NOT NULL GROUP BY 1, 2",
}
