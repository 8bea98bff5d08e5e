"""Queries of the store reads, paths and resolution (inventory R, X, J), with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.operators import paths, reads, resolve, vectors
from vaultframe.queries.problems import _P5
from vaultframe.session import table

ROW = ["path", "content_hash", "byte_length", "generation"]


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _some_path(spark: SparkSession, sf: str) -> str:
    return _docs(spark, sf).agg(F.max("path")).first()[0]


def r01_document(spark, sf):
    return _docs(spark, sf).filter(F.col("path") == _some_path(spark, sf)).select(*ROW)


def r02_page(spark, sf):
    return reads.page(_docs(spark, sf).select(*ROW), "path", "delta", 100)


def r03_subtree_page(spark, sf):
    return reads.subtree_page(_docs(spark, sf).select(*ROW), "delta-vault", True, None, 200)


def r04_under_page(spark, sf):
    return reads.subtree_page(_docs(spark, sf).select(*ROW), "delta-vault/notes", False, "delta-vault/notes/b", 200)


def r05_folded_page(spark, sf):
    return reads.folded_page(_docs(spark, sf).select(*ROW), "heron-desk/notes/Z", 150)


def r06_document_facts(spark, sf):
    """Every document's facts, each set in order of emission, late repeats dropped."""
    out = _docs(spark, sf).select("doc_id", "path")
    for name, field in (("links", "target"), ("headings", "slug"), ("document_tags", "name")):
        rows = reads.newest(table(spark, sf, name), "document", "ordinal").select("document", "ordinal", F.concat(F.col("ordinal").cast("string"), F.lit("="), F.col(field)).alias("fact"))
        grouped = rows.groupBy(F.col("document").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "fact"))).alias(name))
        out = out.join(grouped, "doc_id", "left").withColumn(name, F.coalesce(F.array_join(F.col(f"{name}.fact"), "|"), F.lit("")))
    return out


def r07_tombstone(spark, sf):
    dead = table(spark, sf, "tombstones")
    return dead.filter(F.col("path") == dead.agg(F.min("path")).first()[0])


def r11_tombstone_page(spark, sf):
    return reads.page(table(spark, sf, "tombstones"), "path", "d", 64)


def r12_living_feed(spark, sf):
    return reads.feed(_docs(spark, sf), ["content_hash", "body_hash", "frontmatter_projection_hash"], 3, "cinder", 500)


def r13_death_feed(spark, sf):
    return reads.feed(table(spark, sf, "tombstones"), ["last_content_hash", "provenance"], 2, "d", 500)


def r14_merged_feed(spark, sf):
    return reads.merged_feed(_docs(spark, sf), table(spark, sf, "tombstones"))


def r15_suffix_page(spark, sf):
    k = F.col("suffix_key")
    return _docs(spark, sf).select("path", "suffix_key").filter((F.col("path") >= "delta-annex") & ((F.col("path") > "delta-annex") | (k > "x"))).orderBy("path", "suffix_key").limit(256)


def r18_pillars(spark, sf):
    return reads.pillar_counts({n: table(spark, sf, n) for n in ("documents", "links", "headings", "document_tags", "tombstones", "document_vectors")})


def r19_suffix_candidates(spark, sf):
    return reads.suffix_candidates(_docs(spark, sf).select("suffix_key", "path"), "house-style")


def x03_dotted_target(spark, sf):
    return reads.suffix_candidates(_docs(spark, sf).select("suffix_key", "path"), "house-style.md")


def x01_suffix_key(spark, sf):
    return _docs(spark, sf).select("path", paths.suffix_key(F.col("path")).alias("suffix_key"))


def x02_stem(spark, sf):
    return _docs(spark, sf).select("path", paths.stem(F.element_at(paths.segments(F.col("path")), -1)).alias("stem"))


def x03_probes(spark, sf):
    t = table(spark, sf, "links").filter("protocol is null and family = 'wikilink' and target <> ''").select("target").distinct()
    return t.select("target", F.explode(paths.probe_keys(F.col("target"))).alias("probe"))


def x04_classes(spark, sf):
    return _docs(spark, sf).groupBy(paths.class_key(F.col("path")).alias("class_key")).agg(F.count(F.lit(1)).alias("members"))


def x05_refusals(spark, sf):
    t = table(spark, sf, "links").filter("protocol is null").select("target").distinct()
    return t.select("target", paths.refusal(F.col("target")).alias("refusal"))


def x07_descendants(spark, sf):
    """How many documents lie under each folder, at any depth."""
    segs = paths.segments(F.col("path"))
    folders = F.transform(F.sequence(F.lit(1), F.size(segs) - 1), lambda n: F.concat_ws("/", F.slice(segs, 1, n)))
    return _docs(spark, sf).filter(F.size(segs) > 1).select(F.explode(folders).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("documents"))


def x09_links_to(spark, sf):
    return resolve.backlinks(table(spark, sf, "links"), _docs(spark, sf))


def x10_relative(spark, sf):
    return resolve.markdown_links(table(spark, sf, "links"), _docs(spark, sf)).select("document", "ordinal", "there")


def x11_minimal_suffix(spark, sf):
    return resolve.minimal_suffix(_docs(spark, sf))


def x12_candidate_head(spark, sf):
    return resolve.candidates(table(spark, sf, "links"), _docs(spark, sf)).select("target", "total", F.array_join("head", "|").alias("head"))


def parse15_resolution(spark, sf):
    links = resolve.mode(reads.newest(table(spark, sf, "links"), "document", "ordinal"))
    return links.groupBy("family", "resolution").agg(F.count(F.lit(1)).alias("links"))


def j03_semi(spark, sf):
    """Documents with a link that carries an anchor."""
    return _docs(spark, sf).join(table(spark, sf, "links").filter("anchor is not null"), F.col("doc_id") == F.col("document"), "left_semi").select("path")


def j04_anti(spark, sf):
    return _docs(spark, sf).join(table(spark, sf, "headings"), F.col("doc_id") == F.col("document"), "left_anti").select("path")


def j05_outer(spark, sf):
    """Rows and deaths by path: what stands, what is dead, what stands again, and whether its hash moved."""
    live = _docs(spark, sf).select("path", F.col("content_hash").alias("live"))
    dead = table(spark, sf, "tombstones").select("path", "last_content_hash", F.lit(True).alias("dead"))
    state = F.when(F.col("dead").isNull(), "live").when(F.col("live").isNull(), "dead").when(F.col("live").eqNullSafe(F.col("last_content_hash")), "same").otherwise("moved")
    return live.join(dead, "path", "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("paths"))


def _vectors(spark, sf):
    return table(spark, sf, "document_vectors").select("document", "model_id", "model_version", "content_hash", "generation")


def j06_stale_vectors(spark, sf):
    return vectors.stale(_vectors(spark, sf), _docs(spark, sf)).select("document", "model_id", "model_version", "generation").distinct()


def s12_vector_sink(spark, sf):
    """The rows an upsert by (document, model, version) keeps: the latest generation, of known documents only."""
    return vectors.stored(_vectors(spark, sf), _docs(spark, sf))


def x13_anchor(spark, sf):
    """Links with an anchor, by family: how many find it in a document they name, a wikilink's by text, a Markdown link's by slug."""
    found = resolve.anchors(table(spark, sf, "links"), _docs(spark, sf), table(spark, sf, "headings"))
    return found.groupBy("family", "verdict").agg(F.count(F.lit(1)).alias("links"))


def parse22_sections(spark, sf):
    """Each heading's section: to the next heading of the same or a higher level, or the body's end."""
    return reads.section_bounds(table(spark, sf, "headings"), _docs(spark, sf)).select("document", "ordinal", "start", "stop")


_STEM = r"regexp_replace({}, '^(.+)\.[^.]*$', '\1')"
_REDUCED = r"regexp_replace({}, '^(.*[^/])\.[^./]*$', '\1')"
_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COLS = ", ".join(ROW)
_SUFFIX = f"suffix AS (SELECT doc_id, path, suffix_key, array_to_string(segs[i:], '/') AS called FROM (SELECT doc_id, path, suffix_key, string_split({_REDUCED.format('path')}, '/') AS segs FROM documents), LATERAL (SELECT unnest(range(1, len(segs) + 1)) AS i))"
_LINK = "link AS (SELECT DISTINCT document, ordinal, family, target, anchor FROM links WHERE protocol IS NULL)"
_THERE = """there AS (
  SELECT l.document, l.ordinal, nullif(list_reduce(list_concat([CASE WHEN starts_with(target, '/') OR d.path NOT LIKE '%/%' THEN '' ELSE regexp_replace(d.path, '/[^/]*$', '') END], string_split(target, '/')),
    lambda acc, s: CASE WHEN acc = chr(1) OR s = '.' OR s = '' THEN acc WHEN s = '..' THEN CASE WHEN acc = '' THEN chr(1) WHEN acc LIKE '%/%' THEN regexp_replace(acc, '/[^/]*$', '') ELSE '' END WHEN acc = '' THEN s ELSE acc || '/' || s END), chr(1)) AS there
  FROM link l JOIN documents d ON d.doc_id = l.document WHERE l.family = 'markdown' AND l.target <> '')"""


def _facts(name: str, field: str) -> str:
    return f"coalesce((SELECT string_agg(o || '=' || v, '|' ORDER BY o) FROM (SELECT DISTINCT ordinal AS o, {field} AS v FROM {name} WHERE document = d.doc_id)), '') AS {name}"


ORACLES = {
    "r01_document": f"SELECT {_COLS} FROM documents WHERE path = (SELECT max(path) FROM documents)",
    "r02_page": f"SELECT {_COLS} FROM documents WHERE path > 'delta' ORDER BY path LIMIT 100",
    "r03_subtree_page": f"SELECT {_COLS} FROM documents WHERE path = 'delta-vault' OR starts_with(path, 'delta-vault/') ORDER BY path LIMIT 200",
    "r04_under_page": f"SELECT {_COLS} FROM documents WHERE starts_with(path, 'delta-vault/notes/') AND path > 'delta-vault/notes/b' ORDER BY path LIMIT 200",
    "r05_folded_page": f"SELECT {_COLS} FROM documents WHERE ({_ASCII.format('path')}, path) > ({_ASCII.format(repr('heron-desk/notes/Z'))}, 'heron-desk/notes/Z') ORDER BY {_ASCII.format('path')}, path LIMIT 150",
    "r06_document_facts": f"SELECT doc_id, path, {_facts('links', 'target')}, {_facts('headings', 'slug')}, {_facts('document_tags', 'name')} FROM documents d",
    "r07_tombstone": "SELECT * FROM tombstones WHERE path = (SELECT min(path) FROM tombstones)",
    "r11_tombstone_page": "SELECT * FROM tombstones WHERE path > 'd' ORDER BY path LIMIT 64",
    "r12_living_feed": "SELECT generation, path, content_hash, body_hash, frontmatter_projection_hash FROM documents WHERE (generation, path) > (3, 'cinder') ORDER BY generation, path LIMIT 500",
    "r13_death_feed": "SELECT generation, path, last_content_hash, provenance FROM tombstones WHERE (generation, path) > (2, 'd') ORDER BY generation, path LIMIT 500",
    "r14_merged_feed": "SELECT generation, path, 'document' AS kind, content_hash FROM documents UNION ALL SELECT generation, path, 'death', last_content_hash FROM tombstones t WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.path = t.path AND d.generation = t.generation)",
    "r15_suffix_page": "SELECT path, suffix_key FROM documents WHERE (path, suffix_key) > ('delta-annex', 'x') ORDER BY path, suffix_key LIMIT 256",
    "r18_pillars": " UNION ALL ".join(f"SELECT '{n}' AS pillar, count(*) AS rows FROM {n}" for n in ("documents", "links", "headings", "document_tags", "tombstones", "document_vectors")),
    "r19_suffix_candidates": "SELECT suffix_key, path FROM documents WHERE starts_with(suffix_key, 'house-style/')",
    "x03_dotted_target": "SELECT suffix_key, path FROM documents WHERE starts_with(suffix_key, 'house-style/') OR starts_with(suffix_key, 'house-style.md/')",
    "x01_suffix_key": "SELECT path, suffix_key FROM documents",
    "x02_stem": f"SELECT path, {_STEM.format(chr(39) + chr(39) + ' || string_split(path, ' + chr(39) + '/' + chr(39) + ')[-1]')} AS stem FROM documents",
    "x03_probes": f"WITH t AS (SELECT DISTINCT target FROM links WHERE protocol IS NULL AND family = 'wikilink' AND target <> '') SELECT target, array_to_string(list_reverse(string_split(f, '/')), '/') || '/' AS probe FROM (SELECT target, target AS f FROM t UNION SELECT target, {_REDUCED.format('target')} FROM t)",
    "x04_classes": "SELECT string_split(suffix_key, '/')[1] || '/' AS class_key, count(*) AS members FROM documents GROUP BY 1",
    "x05_refusals": r"""
SELECT target, CASE WHEN target = '' THEN 'empty' WHEN starts_with(target, '/') THEN 'absolute' WHEN contains(target, '\') THEN 'backslash' WHEN regexp_matches(target, '[\x00-\x1f\x7f-\x{9f}]') THEN 'control'
  WHEN list_contains(string_split(target, '/'), '') THEN 'empty-segment' WHEN list_contains(string_split(target, '/'), '.') OR list_contains(string_split(target, '/'), '..') THEN 'dot-segment'
  WHEN regexp_matches(target, '(^|/)\.+$') THEN 'dot-stem' END AS refusal FROM (SELECT DISTINCT target FROM links WHERE protocol IS NULL)""",
    "x07_descendants": "SELECT array_to_string(segs[1:i], '/') AS folder, count(*) AS documents FROM (SELECT string_split(path, '/') AS segs FROM documents), LATERAL (SELECT unnest(range(1, len(segs))) AS i) GROUP BY 1",
    "x09_links_to": f"""
WITH {_SUFFIX}, {_LINK}, {_THERE}, hit AS (
  SELECT s.path FROM link l JOIN suffix s ON s.called = l.target OR s.called = {_REDUCED.format('l.target')} WHERE family = 'wikilink' AND target <> ''
  UNION ALL SELECT d.path FROM there t JOIN documents d ON d.path = t.there
  UNION ALL SELECT d.path FROM link l JOIN documents d ON d.doc_id = l.document WHERE target = ''
) SELECT d.path, count(h.path) AS backlinks FROM documents d LEFT JOIN hit h ON h.path = d.path GROUP BY 1""",
    "x10_relative": f"WITH {_LINK}, {_THERE} SELECT document, ordinal, there FROM there",
    "x11_minimal_suffix": """
WITH k AS (SELECT path, i, array_to_string(list_slice(string_split(suffix_key, '/'), 1, i), '/') || '/' AS key FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(suffix_key, '/')))) AS i)),
u AS (SELECT path, i, key FROM k WHERE key IN (SELECT key FROM k GROUP BY 1 HAVING count(*) = 1))
SELECT d.path, (SELECT min_by(key, i) FROM u WHERE u.path = d.path) AS minimal FROM documents d""",
    "x12_candidate_head": f"""
WITH {_SUFFIX}, t AS (SELECT DISTINCT target FROM links WHERE protocol IS NULL AND family = 'wikilink' AND target <> ''),
c AS (SELECT t.target, s.path, row_number() OVER (PARTITION BY t.target ORDER BY s.suffix_key, s.path) AS n FROM t JOIN suffix s ON s.called = t.target OR s.called = {_REDUCED.format('t.target')})
SELECT t.target, count(c.path) AS total, coalesce(string_agg(c.path, '|' ORDER BY n) FILTER (n <= 5), '') AS head FROM t LEFT JOIN c ON c.target = t.target GROUP BY 1""",
    "parse15_resolution": "SELECT family, CASE WHEN protocol IS NOT NULL THEN 'protocol' WHEN family = 'wikilink' THEN 'suffix' ELSE 'relative' END AS resolution, count(*) AS links FROM (SELECT DISTINCT document, ordinal, family, protocol FROM links) GROUP BY 1, 2",
    "j03_semi": "SELECT path FROM documents WHERE doc_id IN (SELECT document FROM links WHERE anchor IS NOT NULL)",
    "j04_anti": "SELECT path FROM documents WHERE doc_id NOT IN (SELECT document FROM headings)",
    "j05_outer": "SELECT CASE WHEN t.path IS NULL THEN 'live' WHEN d.path IS NULL THEN 'dead' WHEN d.content_hash IS NOT DISTINCT FROM t.last_content_hash THEN 'same' ELSE 'moved' END AS state, count(*) AS paths FROM documents d FULL JOIN tombstones t ON d.path = t.path GROUP BY 1",
    "j06_stale_vectors": "SELECT DISTINCT v.document, model_id, model_version, v.generation FROM document_vectors v JOIN documents d ON d.doc_id = v.document WHERE v.content_hash <> d.content_hash",
    "s12_vector_sink": "SELECT document, model_id, model_version, max(generation) AS generation, max_by(content_hash, (generation, content_hash)) AS content_hash FROM document_vectors WHERE document IN (SELECT doc_id FROM documents) GROUP BY 1, 2, 3",
    "x13_anchor": _P5 + " SELECT o.family, CASE missing_in WHEN 'documents' THEN 'target-missing' WHEN 'headings' THEN 'anchor-missing' ELSE 'found' END AS verdict, count(*) AS links FROM named o JOIN orphan USING (document, ordinal) WHERE o.anchor IS NOT NULL GROUP BY 1, 2",
    "parse22_sections": """
WITH h AS (SELECT DISTINCT document, ordinal, level, span_offset, body_offset FROM headings)
SELECT h.document, h.ordinal, h.body_offset AS start, coalesce((SELECT min(n.span_offset) FROM h n WHERE n.document = h.document AND n.ordinal > h.ordinal AND n.level <= h.level), d.byte_length - d.body_offset) AS stop
FROM h JOIN documents d ON d.doc_id = h.document""",
}

QUERIES = {k: globals()[k] for k in ORACLES}
