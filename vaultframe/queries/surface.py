"""Queries of the remaining surface: sources, formats, quarantine, upkeep of indexes, sections and forecasts, with the SQL that must agree."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from vaultframe.functions import frontmatter, parse
from vaultframe.operators import findings, formats, fulltext, paths, predicates as P, quarantine, reads
from vaultframe.plans import edits, plans
from vaultframe.session import materialize, spread, table
from vaultframe.sources import vault
from vaultframe.streaming import watch


def _docs(spark, sf):
    return table(spark, sf, "documents")


def s04_exclusions(spark, sf):
    hit = vault.excluded(F.col("path"), ["delta-vault", "heron-desk/notes"])
    return _docs(spark, sf).groupBy(hit.alias("excluded")).agg(F.count(F.lit(1)).alias("documents"))


def s05_membership(spark, sf):
    names = _docs(spark, sf).select("path").unionByName(table(spark, sf, "links").filter("family = 'markdown'").select(F.col("target").alias("path"))).distinct()
    return names.select("path", vault.is_markdown(F.col("path")).alias("markdown"))


def s14_jsonl(spark, sf):
    return formats.jsonl(_docs(spark, sf).select("path", "generation"))


def s14_markdown(spark, sf):
    return formats.markdown(_docs(spark, sf).select("path", "generation", P.raw("type").alias("type")))


def s14_records(spark, sf):
    return formats.records(_docs(spark, sf).select("path", "generation", P.raw("type").alias("type")))


def s14_paths(spark, sf):
    return formats.paths_only(_docs(spark, sf).filter(P.eq("type", "task")))


def s14_json(spark, sf):
    return formats.json_array(_docs(spark, sf).select("path", "generation"))


def s14_report(spark, sf):
    counts = _docs(spark, sf).groupBy(F.coalesce(P.raw("type"), F.lit("(missing)")).alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return formats.report(counts, "documents")


def j00_match_paths(spark, sf):
    """Documents with a phrase, in path order."""
    index = fulltext.postings(_docs(spark, sf), "doc_id", "body")
    return fulltext.documents(fulltext.match_phrase(index, "the moss"), _docs(spark, sf)).select("path", "content_hash")


def parse08_field_texts(spark, sf):
    """Every string of each frontmatter field: a scalar, or the items of a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, s[0], s[1]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for s in frontmatter.read(t).strings]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.string()), (2, pa.string()))], names=["doc_id", "field", "text"])

    return spread(_docs(spark, sf).select("doc_id", "text")).mapInArrow(run, "doc_id bigint, field string, text string")


def parse07_fields(spark, sf):
    """Each frontmatter field with the style its value is written in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *f) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for f in frontmatter.fields(t)]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=["doc_id", "field", "start", "stop", "style"])

    return spread(_docs(spark, sf).select("doc_id", "text")).mapInArrow(run, "doc_id bigint, field string, start bigint, stop bigint, style string")


def parse21_blocks(spark, sf):
    """Block ids planted at the end of bodies without code or markup."""
    d = _docs(spark, sf).filter("body is not null and not body rlike '[`~<]'")
    planted = d.select("doc_id", F.concat("body", F.lit("\n\nplanted ^b"), F.col("doc_id").cast("string"), F.lit(" \nno^id ^not an id\n")).alias("text"))
    return parse.block_ids(planted, "doc_id", "text").select("document", "ordinal", "block_id")


def parse07_field_names(spark, sf):
    return parse07_fields(spark, sf).select("doc_id", "field").distinct()


def parse25_mapping(spark, sf):
    """How each document's reading ends."""
    parsed = parse.parse(_docs(spark, sf), "doc_id", "text").select("doc_id", "status", F.col("body").alias("read"))
    state = quarantine.kind(F.col("path"), F.col("read"), F.col("status"))
    return _docs(spark, sf).select("doc_id", "path").join(parsed, "doc_id").groupBy(F.coalesce(state, F.lit("read")).alias("outcome")).agg(F.count(F.lit(1)).alias("documents"))


def f19_section(spark, sf):
    """The content of the sections under headings named `Log`, without blank lines at its edges."""
    found = edits.sections(spread(_docs(spark, sf).select("doc_id", "body").filter("contains(body, 'Log')")), "doc_id", "body").filter("text = 'Log'")
    return found.select(F.col("doc_id").alias("document"), "ordinal", F.regexp_replace("content", r"^[ \t\r\n]+|[ \t\r\n]+$", "").alias("content"))


def parse23_contents(spark, sf):
    """Of every section: the bytes of its content, of what is left of it without white space at its edges, and whether there is any."""
    found = edits.sections(spread(_docs(spark, sf).select("doc_id", "body")), "doc_id", "body")
    bare = F.regexp_replace("content", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return found.select(F.col("doc_id").alias("document"), "ordinal", F.octet_length(bare).alias("bytes"), F.md5(bare).alias("content_md5"))


def r08_subjects_without_rows(spark, sf):
    """Paths with a finding of a place and no document."""
    return reads.finding_subjects(_states()._place_records(spark, sf), _docs(spark, sf), quarantine.PLACE_KINDS[1:], None, 1000)


_SHOWN = ["kind", "severity", "path", "target", "candidates_total", "message"]


def _flat(df):
    return df.select(*_SHOWN, F.array_join(F.transform("candidates", lambda c: F.concat(c["path"], F.lit("="), c["suffix"])), "|").alias("candidates"), F.array_join(F.array_sort("class_keys"), "|").alias("class_keys"))


def r09_findings_for_path(spark, sf):
    """The findings of the first path with an ambiguous link, candidates and classes with them."""
    found = _states()._records(spark, sf)
    first = found.filter("kind = 'link-ambiguous'").agg(F.min("path")).first()[0]
    return _flat(reads.findings_for_path(found.withColumn("generation", F.lit(1)), first or ""))


def r10_finding_page(spark, sf):
    """A page of findings after an id."""
    return _flat(reads.finding_page(_states()._records(spark, sf), "4", 200))


def i05_subject_discard(spark, sf):
    """Findings that stay when every path with a tombstone changes."""
    f = _states()._found(spark, sf)
    return f.join(table(spark, sf, "tombstones").select("path"), "path", "left_anti").groupBy("code").agg(F.count(F.lit(1)).alias("findings"))


def x06_rendered(spark, sf):
    return table(spark, sf, "links").filter("protocol is null").select("target").distinct().select("target", quarantine.rendered(F.col("target")).alias("rendered"))


def x06_rendered_paths(spark, sf):
    """Spellings that are refused in every way: control characters, backslashes, empty and dot segments, leaves of dots."""
    k, p = F.pmod(F.col("doc_id"), F.lit(6)), F.col("path")
    bad = F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.replace(p, F.lit("/"), F.lit("\\"))).when(k == 2, F.concat(F.lit("../"), p)).when(k == 3, F.concat(p, F.lit("/..md"))).when(k == 4, F.concat(F.lit("a\u0085b/.../"), p)).otherwise(p)
    return _docs(spark, sf).select("doc_id", bad.alias("spelling")).select("doc_id", paths.refusal(F.col("spelling")).alias("refusal"), quarantine.rendered(F.col("spelling")).alias("rendered"))


def x08_normalized(spark, sf):
    """Access paths: `.` and doubled separators dropped, `..` and a root refused; and their identity where case folds."""
    t = table(spark, sf, "links").filter("protocol is null and family = 'markdown'").select("target").distinct()
    return t.select("target", paths.normal(F.col("target")).alias("normal"), paths.normal_refusal(F.col("target")).alias("refusal"), paths.ascii_fold(paths.normal(F.col("target"))).alias("identity"))


def t03_drift(spark, sf):
    """An index that was stored before a tenth of the documents came and a thirteenth changed, against one derived now."""
    docs = _docs(spark, sf).select("doc_id", "body")
    then = docs.filter("pmod(doc_id, 10) <> 0").withColumn("body", F.when(F.pmod("doc_id", F.lit(13)) == 0, "moss and stale moss").otherwise(F.col("body")))
    index = lambda d: fulltext.postings(d, "doc_id", "body").select("term", "doc", F.size("positions").alias("n"))
    return fulltext.drift(materialize(index(then), "stored"), materialize(index(docs), "derived"))


def l13_kinds(spark, sf):
    """The six kinds of finding of a read file, over files of which some have paths that aren't UTF-8 or aren't allowed."""
    path = F.when(F.pmod("doc_id", F.lit(31)) == 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path"))
    files = _docs(spark, sf).select("doc_id", path.alias("path"), (F.pmod("doc_id", F.lit(37)) != 0).alias("utf8"))
    parsed = parse.parse(_docs(spark, sf), "doc_id", "text").select("doc_id", "status", F.col("body").alias("read"))
    kind = quarantine.kind(F.col("path"), F.col("read"), F.col("status"), F.col("utf8"))
    return files.join(parsed, "doc_id").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"))


def l15_exit(spark, sf):
    """1 if any finding is an error, else 0."""
    return _states()._found(spark, sf).agg(F.coalesce(F.max((F.col("severity") == "error").cast("int")), F.lit(0)).alias("exit"))


def m02_scoped(spark, sf):
    """What the dirty folders of the dead paths come to, against a store that missed some documents and holds others as they were."""
    d = _docs(spark, sf)
    held = d.filter("pmod(doc_id, 7) <> 0").withColumn("content_hash", F.when(F.pmod("doc_id", F.lit(5)) == 0, "before").otherwise(F.col("content_hash"))).select("path", "content_hash")
    held = held.unionByName(table(spark, sf, "tombstones").join(d, "path", "left_anti").select("path", F.coalesce("last_content_hash", F.lit("")).alias("content_hash")))
    roots = table(spark, sf, "tombstones").select(F.regexp_replace("path", "/[^/]*$", "").alias("root"))
    return watch.scoped_changes(roots, d, held).select("path", "kind", "content_hash")


def m05_prune(spark, sf):
    """Findings that stay after a clean walk of two folders that accounted for every other document."""
    roots = spark.createDataFrame([("delta-vault",), ("heron-desk/notes",)], "root string")
    kept = findings.prune(_states()._found(spark, sf), roots, _docs(spark, sf).filter("pmod(doc_id, 2) = 0").select("path"))
    return kept.groupBy("code").agg(F.count(F.lit(1)).alias("findings"))


def m04_withheld(spark, sf):
    """Findings of places that are recorded: those where no document stands."""
    return findings.withheld(_states()._place_records(spark, sf), _docs(spark, sf)).select("kind", "path")


def m07_merge(spark, sf):
    """Batches of dirty roots as one: the folders of dead paths, one of them reported gone."""
    roots = table(spark, sf, "tombstones").select(F.regexp_replace("path", "/[^/]*$", "").alias("root"))
    gone = roots.agg(F.max("root").alias("root")).filter("root is not null").withColumn("gone", F.lit(True))
    top = roots.select(F.substring_index("root", "/", 1).alias("root"))
    batches = roots.unionByName(top).withColumn("gone", F.lit(False)).unionByName(gone).withColumn("rescan", F.lit(False))
    return watch.merge_batches(batches)


def m04_quarantine(spark, sf):
    """Rows dropped if every file without text were quarantined."""
    d = _docs(spark, sf)
    found = d.select("path", quarantine.kind(F.col("path"), F.col("text"), F.lit("read")).alias("finding")).filter("finding is not null")
    return quarantine.quarantine_changes(found, d)


def d05_set(spark, sf):
    """Of tasks: a status set, a tag pushed, another popped, a field removed, and a type that isn't allowed."""
    tasks = _docs(spark, sf).filter(P.eq("type", "task"))
    plan = plans.set_plan(tasks, fields={"status": "done", "type": "chore"}, push={"tags": "swept"}, remove=["project"], allowed={"type": ["task", "note"]}, known=["status", "type", "tags", "created"])
    return plan.unionByName(plans.set_plan(tasks, pop={"aliases": "house"})).drop("ordinal")


def d06_edit(spark, sf):
    """Each kind of edit tried on each body's `Log` section: applied, or why it is refused."""
    rows = _docs(spark, sf).filter("body is not null").select("doc_id", "body")
    tried = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("op"), F.lit(json.dumps([{"op": k, "heading": "Log", "content": "done"}])).alias("ops")) for k in edits.OPERATIONS[1:]])).alias("e"), "doc_id", "body").select(F.struct("doc_id", "e.op").alias("k"), "body", "e.ops")
    return edits.edit(tried, "k", "body", "ops").groupBy("k.op", F.coalesce("refusal", F.lit("applied")).alias("outcome")).agg(F.count(F.lit(1)).alias("documents"))


_HEADS = "h AS (SELECT document, count(DISTINCT ordinal) FILTER (text = 'Log') AS n, bool_or(inside_container) FILTER (text = 'Log') AS boxed FROM headings GROUP BY 1)"


def _states():
    from vaultframe.queries import states

    return states


def _sections() -> str:
    from vaultframe.queries import reads as r

    return r.ORACLES["parse22_sections"]


_EDGES = r"'^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'"
_CONTENT = f"WITH s AS ({_sections()}), h AS (SELECT DISTINCT document, ordinal, text FROM headings), c AS (SELECT s.document, s.ordinal, h.text, regexp_replace(decode(encode(d.body)[s.start + 1 : s.stop]), {_EDGES}) AS content FROM s JOIN h ON h.document = s.document AND h.ordinal = s.ordinal JOIN documents d ON d.doc_id = s.document)"
_RECORDS = f"WITH {_states()._ALL}, {_states()._AS_RECORDS}"
# what the grammar refuses, stated once more: the text whole, then each segment, then the leaf
_REFUSES = r"""CASE WHEN {0} = '' THEN 'empty' WHEN starts_with({0}, '/') THEN 'absolute' WHEN contains({0}, '\') THEN 'backslash' WHEN regexp_matches({0}, '[\x00-\x1f\x7f-\x{{9f}}]') THEN 'control'
  WHEN list_contains(string_split({0}, '/'), '') THEN 'empty-segment' WHEN list_contains(string_split({0}, '/'), '.') OR list_contains(string_split({0}, '/'), '..') THEN 'dot-segment' WHEN regexp_matches(regexp_replace({0}, '([^/])\.[^./]*$', '\1'), '(^|/)\.+$') THEN 'dot-stem' END"""
_RENDERED = (
    r"""
WITH bad AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/' || path WHEN 1 THEN replace(path, '/', '\') WHEN 2 THEN '../' || path WHEN 3 THEN path || '/..md' WHEN 4 THEN 'a' || chr(133) || 'b/.../' || path ELSE path END AS spelling FROM documents),
spelled AS (SELECT DISTINCT coalesce({0}, '') AS spelling FROM """
    + "(SELECT spelling, NULL AS target FROM bad UNION ALL SELECT NULL, target FROM links WHERE protocol IS NULL)), seg AS (SELECT spelling, "
    + _REFUSES.format("spelling").replace("{", "{{").replace("}", "}}")
    + r""" AS refusal, array_to_string(list_transform(string_split(regexp_replace(spelling, '[\x00-\x1f\x7f-\x{{9f}}\\]', '�', 'g'), '/'), lambda s: CASE WHEN s IN ('', '.', '..') THEN '�' || s ELSE s END), '/') AS marked FROM spelled),
rendered AS (SELECT spelling, refusal, CASE WHEN refusal IS NULL THEN spelling WHEN ("""
    + _REFUSES.format("marked").replace("{", "{{").replace("}", "}}")
    + r""") IS NULL THEN marked ELSE regexp_replace(marked, '([^/]*)$', '�\1') END AS rendered FROM seg)"""
)
_TYPE = "(frontmatter ->> '$.\"type\"')"
_STATUS = "(frontmatter ->> '$.\"status\"')"

ORACLES = {
    "s04_exclusions": "SELECT starts_with(path, 'delta-vault/') OR starts_with(path, 'heron-desk/notes/') AS excluded, count(*) AS documents FROM documents GROUP BY 1",
    "s05_membership": r"SELECT path, ends_with(lower(path), '.md') AS markdown FROM (SELECT path FROM documents UNION SELECT target FROM links WHERE family = 'markdown')",
    "s14_jsonl": "SELECT to_json({'path': path, 'generation': generation})::VARCHAR AS line FROM documents",
    "s14_markdown": f"SELECT '| ' || replace(path, '|', '\\|') || ' | ' || generation || ' | ' || coalesce({_TYPE}, '') || ' |' AS line FROM documents",
    "s14_records": f"SELECT concat_ws(chr(10), path, '  generation: ' || generation, '  type: ' || {_TYPE}) AS line FROM documents",
    "s14_paths": f"SELECT path AS line FROM documents WHERE {_TYPE} = 'task' AND json_type(json_extract(frontmatter, '$.\"type\"')) = 'VARCHAR'",
    "s14_json": "SELECT '[' AS line UNION ALL SELECT ']' UNION ALL SELECT to_json({'path': path, 'generation': generation})::VARCHAR || CASE WHEN path = (SELECT max(path) FROM documents) THEN '' ELSE ',' END FROM documents",
    "s14_report": f"SELECT 'documents: ' || count(*) AS line FROM documents UNION ALL SELECT lpad(count(*)::VARCHAR, 8, ' ') || '  ' || coalesce({_TYPE}, '(missing)') FROM documents GROUP BY coalesce({_TYPE}, '(missing)')",
    "j00_match_paths": r"SELECT path, content_hash FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+'), ' ') || ' ', ' the moss ')",
    "parse08_field_texts": """
WITH f AS (SELECT doc_id, unnest(json_keys(frontmatter)) AS k, frontmatter FROM documents WHERE frontmatter IS NOT NULL), v AS (SELECT doc_id, k, json_extract(frontmatter, '$."' || k || '"') AS j FROM f)
SELECT doc_id, k AS field, j ->> '$' AS text FROM v WHERE json_type(j) = 'VARCHAR' UNION ALL SELECT doc_id, k, x ->> '$' FROM (SELECT doc_id, k, unnest(json_extract(j, '$[*]')) AS x FROM v WHERE json_type(j) = 'ARRAY') WHERE json_type(x) = 'VARCHAR'""",
    "parse21_blocks": "SELECT doc_id AS document, 0 AS ordinal, 'b' || doc_id AS block_id FROM documents WHERE body IS NOT NULL AND NOT regexp_matches(body, '[`~<]')",
    "parse07_field_names": "SELECT doc_id, unnest(json_keys(frontmatter)) AS field FROM documents WHERE frontmatter IS NOT NULL",
    "f19_section": _CONTENT + " SELECT document, ordinal, content FROM c WHERE text = 'Log'",
    "parse23_contents": _CONTENT + " SELECT document, ordinal, strlen(content)::INT AS bytes, md5(content) AS content_md5 FROM c",
    "r08_subjects_without_rows": "SELECT DISTINCT path FROM tombstones WHERE path NOT IN (SELECT path FROM documents) ORDER BY path LIMIT 1000",
    "r09_findings_for_path": _RECORDS + " SELECT kind, severity, path, target, candidates_total, message, candidates, class_keys FROM records WHERE path = (SELECT min(path) FROM records WHERE kind = 'link-ambiguous')",
    "r10_finding_page": _RECORDS + " SELECT kind, severity, path, target, candidates_total, message, candidates, class_keys FROM records WHERE id > '4' ORDER BY id LIMIT 200",
    "i05_subject_discard": f"WITH {_states()._ALL} SELECT code, count(*) AS findings FROM found WHERE path NOT IN (SELECT path FROM tombstones) GROUP BY 1",
    "x06_rendered": _RENDERED.format("target") + " SELECT target, rendered FROM (SELECT DISTINCT target FROM links WHERE protocol IS NULL) JOIN rendered ON spelling = coalesce(target, '')",
    "x06_rendered_paths": _RENDERED.format("spelling") + " SELECT doc_id, refusal, rendered FROM bad JOIN rendered USING (spelling)",
    "x08_normalized": """
WITH t AS (SELECT DISTINCT target, list_filter(string_split(target, '/'), lambda s: s NOT IN ('', '.')) AS segs FROM links WHERE protocol IS NULL AND family = 'markdown'),
n AS (SELECT target, CASE WHEN target IS NULL OR target = '' THEN 'empty' WHEN starts_with(target, '/') THEN 'absolute' WHEN list_contains(segs, '..') THEN 'parent-traversal' WHEN len(segs) = 0 THEN 'empty' END AS refusal, array_to_string(segs, '/') AS normal FROM t)
SELECT target, CASE WHEN refusal IS NULL THEN normal END AS normal, refusal, CASE WHEN refusal IS NULL THEN translate(normal, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS identity FROM n""",
    "t03_drift": r"""
WITH now AS (SELECT doc_id, body FROM documents), was AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'moss and stale moss' ELSE body END AS body FROM documents WHERE doc_id % 10 <> 0),
a AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+')) AS term FROM was) GROUP BY ALL),
b AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+')) AS term FROM now) GROUP BY ALL)
SELECT 'stored' AS side, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS rows UNION ALL SELECT 'derived', (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""",
    "l15_exit": f"WITH {_states()._ALL} SELECT max((severity = 'error')::INT) AS exit FROM found",
    "m02_scoped": r"""
WITH roots AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM tombstones), held AS (
  SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'before' ELSE content_hash END AS content_hash FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT path, coalesce(last_content_hash, '') FROM tombstones WHERE path NOT IN (SELECT path FROM documents)
), m AS (SELECT coalesce(d.path, h.path) AS path, d.content_hash AS now, h.content_hash AS held FROM documents d FULL JOIN held h ON h.path = d.path)
SELECT path, CASE WHEN now IS NULL THEN 'death' ELSE 'upsert' END AS kind, now AS content_hash FROM m
WHERE (now IS NULL OR held IS NULL OR now <> held) AND EXISTS (SELECT 1 FROM roots r WHERE m.path = r.root OR starts_with(m.path, r.root || '/'))""",
    "m05_prune": f"WITH {_states()._ALL} SELECT code, count(*) AS findings FROM found WHERE NOT (starts_with(path, 'delta-vault/') OR starts_with(path, 'heron-desk/notes/')) OR path IN (SELECT path FROM documents WHERE doc_id % 2 = 0) GROUP BY 1",
    "m04_withheld": "SELECT DISTINCT 'document/not-utf8' AS kind, path FROM tombstones WHERE path NOT IN (SELECT path FROM documents)",
    "m07_merge": r"""
WITH f AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM tombstones), r AS (SELECT root, root = (SELECT max(root) FROM f) AS gone FROM (SELECT root FROM f UNION SELECT string_split(root, '/')[1] FROM f))
SELECT root, gone, root = '' AS rescan FROM r a WHERE gone OR NOT EXISTS (SELECT 1 FROM r b WHERE starts_with(a.root, b.root || '/'))""",
    "m04_quarantine": "SELECT path, 0 AS seq, 'death' AS kind, 'quarantine' AS provenance FROM documents WHERE text IS NULL",
    "d05_set": f"""
WITH t AS (SELECT path, frontmatter AS f FROM documents WHERE {_TYPE} = 'task' AND json_type(json_extract(frontmatter, '$."type"')) = 'VARCHAR'),
v AS (SELECT path, f, CASE json_type(json_extract(f, '$."tags"')) WHEN 'VARCHAR' THEN [f ->> '$."tags"'] WHEN 'ARRAY' THEN CAST(json_extract(f, '$."tags"') AS VARCHAR[]) ELSE [] END AS tags FROM t),
o AS (
  SELECT path, 'status' AS field, json_extract(f, '$."status"')::VARCHAR AS old, '"done"' AS new, NULL AS reason FROM t UNION ALL
  SELECT path, 'type', '"task"', '"chore"', 'value-not-allowed' FROM t UNION ALL
  SELECT path, 'tags', json_extract(f, '$."tags"')::VARCHAR, CASE WHEN list_contains(tags, 'swept') THEN json_extract(f, '$."tags"')::VARCHAR ELSE to_json(list_append(tags, 'swept'))::VARCHAR END, NULL FROM v UNION ALL
  SELECT path, 'project', json_extract(f, '$."project"')::VARCHAR, NULL, 'unknown-field' FROM t UNION ALL
  SELECT path, 'aliases', json_extract(f, '$."aliases"')::VARCHAR, CASE WHEN contains(coalesce(json_extract(f, '$."aliases"')::VARCHAR, ''), '"house"') THEN to_json(list_filter(CASE json_type(json_extract(f, '$."aliases"')) WHEN 'VARCHAR' THEN [f ->> '$."aliases"'] ELSE CAST(json_extract(f, '$."aliases"') AS VARCHAR[]) END, lambda x: x <> 'house'))::VARCHAR ELSE json_extract(f, '$."aliases"')::VARCHAR END, NULL FROM t
), n AS (SELECT path, field, CASE WHEN old = 'null' THEN NULL ELSE old END AS old, CASE WHEN new = 'null' THEN NULL ELSE new END AS new, reason FROM o)
SELECT CASE WHEN new IS NULL THEN 'remove_frontmatter' WHEN old IS NULL THEN 'add_frontmatter' ELSE 'set_frontmatter' END AS kind, path, field, old, new, CASE WHEN reason = 'value-not-allowed' THEN 'refused' WHEN old IS NOT DISTINCT FROM new THEN 'unchanged' ELSE 'planned' END AS status, reason FROM n""",
    "d06_edit": f"WITH {_HEADS} SELECT op, CASE WHEN coalesce(n, 0) = 0 THEN 'no such heading' WHEN n > 1 THEN 'ambiguous heading' WHEN boxed THEN 'the section is inside a container' ELSE 'applied' END AS outcome, count(*) AS documents FROM documents d LEFT JOIN h ON h.document = d.doc_id, (VALUES ('replace_section'), ('append_to_section'), ('delete_section'), ('insert_before_heading'), ('insert_after_heading')) o(op) WHERE body IS NOT NULL GROUP BY 1, 2",
    "l13_kinds": "SELECT CASE WHEN doc_id % 37 = 0 THEN 'document/path-not-utf8' WHEN doc_id % 31 = 0 THEN 'document/path-refused' WHEN text IS NULL THEN 'document/not-utf8' WHEN frontmatter IS NULL AND frontmatter_diagnostic_count > 0 THEN CASE WHEN body_offset > 16392 THEN 'document/frontmatter-too-large' WHEN body_offset > 3 THEN 'document/frontmatter-unreadable' ELSE 'document/frontmatter-unclosed' END END AS kind, count(*) AS files FROM documents GROUP BY 1",
    "parse25_mapping": "SELECT CASE WHEN text IS NULL THEN 'document/not-utf8' WHEN frontmatter IS NULL AND frontmatter_diagnostic_count > 0 THEN CASE WHEN body_offset > 16392 THEN 'document/frontmatter-too-large' WHEN body_offset > 3 THEN 'document/frontmatter-unreadable' ELSE 'document/frontmatter-unclosed' END ELSE 'read' END AS outcome, count(*) AS documents FROM documents GROUP BY 1",
}

QUERIES = {k: globals()[k] for k in [*ORACLES, "parse07_fields"]}
