"""Queries of full text, vectors, findings, the store and plans (inventory R16-R21, T, V, L, I, M, Q, D), with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from vaultframe.functions import parse
from vaultframe.operators import findings, fulltext, predicates as P, quarantine, reads, resolve, store, vectors
from vaultframe.plans import plans
from vaultframe.session import materialize, table


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _index(spark, sf):
    return fulltext.postings(_docs(spark, sf), "doc_id", "body")


def _named(df):
    return df.withColumnRenamed("doc", "doc_id")


def r16_vocabulary(spark, sf):
    return fulltext.vocabulary(_index(spark, sf))


def r21_match_and(spark, sf):
    return _named(fulltext.match_all(_index(spark, sf), ["Short", "moss"]))


def r21_match_or(spark, sf):
    return _named(fulltext.match_any(_index(spark, sf), ["moss", "granero"]))


def r21_match_not(spark, sf):
    return _named(fulltext.match_not(_index(spark, sf), ["moss"], ["river"]))


def r21_match_phrase(spark, sf):
    return _named(fulltext.match_phrase(_index(spark, sf), "the moss"))


def v01_embed(spark, sf):
    return vectors.embed(_docs(spark, sf), "doc_id", "body")


def v02_nearest(spark, sf):
    e = table(spark, sf, "embeddings")
    query = e.filter("vec_id = 0").select("embedding").first()[0]
    return vectors.nearest(e, "vec_id", "embedding", query, 10)


ALLOWED = ["note", "task", "phase", "decision", "log"]


def _rules(spark, sf):
    d = _docs(spark, sf)
    return {
        "l05_required": findings.required(d, "created"),
        "l06_allowed": findings.not_allowed(d, "type", ALLOWED),
        "l07_types": findings.wrong_type(d, "due", "date"),
        "l08_length": findings.too_long(d, "title", 30),
        "l09_forbidden": findings.forbidden(d, "zip"),
        "l10_misrouted": findings.misrouted(d, "task", "**/tasks/**"),
        "l12_unread": findings.unread(d),
    }


def _rule(name):
    return lambda spark, sf: _rules(spark, sf)[name]


def _links_missing(spark, sf):
    return findings.links_missing(table(spark, sf, "links"), _docs(spark, sf), table(spark, sf, "headings"))


def l01_links_missing(spark, sf):
    return _links_missing(spark, sf)


def l03_block_missing(spark, sf):
    return findings.block_missing(table(spark, sf, "links"), parse.block_ids(_docs(spark, sf), "doc_id", "text"), _docs(spark, sf))


def l04_ambiguous(spark, sf):
    return findings.ambiguous(table(spark, sf, "links"), _docs(spark, sf))


def l11_reference_type(spark, sf):
    return findings.reference_type(_docs(spark, sf), "parent", ["note", "task", "phase"])


def _found(spark, sf):
    """All findings: of the rules on fields and paths, and of links."""
    parts = findings.together(*_rules(spark, sf).values(), l01_links_missing(spark, sf), l03_block_missing(spark, sf), l04_ambiguous(spark, sf), l11_reference_type(spark, sf))
    return materialize(parts, "findings")


def _records(spark, sf):
    return findings.records(_found(spark, sf), resolve.candidates(table(spark, sf, "links"), _docs(spark, sf)))


def _place_records(spark, sf):
    """Findings of files that aren't UTF-8: every document without text, and every dead path."""
    at = _docs(spark, sf).filter("text is null").select("path").unionByName(table(spark, sf, "tombstones").select("path"))
    return findings.records(at.select(F.lit("document/not-utf8").alias("code"), F.lit("error").alias("severity"), "path", F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("detail")))


RULE_NAMES = {"required-field-missing": "created", "value-not-allowed": "type", "field-type-invalid": "due", "document-misrouted": "tasks"}


def a08_summary(spark, sf):
    return findings.summary(_found(spark, sf), RULE_NAMES)


def l14_triage(spark, sf):
    """Filters AND across kinds and OR within: codes by glob, severity, folder."""
    return findings.triage(_found(spark, sf), codes=["forbidden-*", "link-a*", "document-misrouted"], severities=["warning"], paths_=["delta-*/**", "heron-*/**"]).select("code", "path", "subject")


def r20_in_class(spark, sf):
    """Findings of the class of the house style, each once."""
    return reads.in_class(_records(spark, sf), "house-style/").select("kind", "path", "target", "message")


def i06_class_discard(spark, sf):
    """Ambiguity findings that stay when all dead paths change."""
    kept = findings.discard_classes(findings.ambiguous(table(spark, sf, "links"), _docs(spark, sf)), findings.affected_classes(table(spark, sf, "tombstones")))
    return kept.groupBy("subject").agg(F.count(F.lit(1)).alias("findings"))


def _events(spark, sf):
    """The event log as changes: `error` is a death, all else an upsert."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("users/u"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("event_type") == "error", "death").otherwise("upsert").alias("kind"), F.col("props").alias("frontmatter"))


def i01_fold(spark, sf):
    return store.fold(_events(spark, sf)).select("path", "kind", "seq", "frontmatter")


def i03_deaths(spark, sf):
    """Deaths of every path of the log that ends dead, against the vault's own tombstones."""
    dead = store.fold(_events(spark, sf)).filter("kind = 'death'").select("path", "seq", "kind", F.lit(None).cast("string").alias("content_hash"), F.lit("watcher-removal").alias("provenance"))
    return store.next_tombstones(table(spark, sf, "tombstones"), _docs(spark, sf), dead, 999, 1).select("path", "last_content_hash", "provenance", "generation")


def i04_guard(spark, sf):
    """Of the documents as a changeset, with some offsets and paths spoilt, the entries that are refused."""
    spoilt = F.when(F.pmod("doc_id", F.lit(11)) == 0, F.replace("path", F.lit("/"), F.lit("\\"))).when(F.pmod("doc_id", F.lit(13)) == 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path"))
    offset = F.col("body_offset") + (F.pmod("doc_id", F.lit(7)) == 0).cast("int")
    rows = _docs(spark, sf).filter("body is not null")
    return rows.select(spoilt.alias("path"), F.lit("upsert").alias("kind"), "body", offset.alias("body_offset"), "byte_length").transform(store.refused)


def _damaged(df, n, column, value):
    """`df` with a column spoilt in every n-th document's rows."""
    key = "doc_id" if "doc_id" in df.columns else "document"
    return df.withColumn(column, F.when(F.pmod(F.col(key), F.lit(n)) == 0, value).otherwise(F.col(column)))


def i09_verify(spark, sf):
    """Integrity of the tables after damage of every kind that is looked for."""
    d = _docs(spark, sf).filter("pmod(doc_id, 101) <> 0")
    for n, column, value in ((97, "body_hash", F.lit("x")), (89, "body_offset", F.col("body_offset") + 1), (83, "suffix_key", F.upper("suffix_key")), (79, "frontmatter", F.substring("frontmatter", 1, 5)), (73, "frontmatter_projection_hash", F.lit(None))):
        d = _damaged(d, n, column, value)
    links, heads, tags = _damaged(table(spark, sf, "links"), 71, "family", F.lit("other")), _damaged(table(spark, sf, "headings"), 67, "level", F.lit(7)), _damaged(table(spark, sf, "document_tags"), 61, "source", F.lit("title"))
    return store.verify(d, links, heads, tags)


def m01_heal(spark, sf):
    """What a walk that finds the living documents does to a store that holds the dead paths."""
    held = table(spark, sf, "tombstones").select("path", F.coalesce("last_content_hash", F.lit("")).alias("content_hash"))
    return store.heal(_docs(spark, sf).select("path", "content_hash"), held)


def m03_rederive(spark, sf):
    """Documents whose frontmatter wasn't read, where findings explain every other one."""
    d = _docs(spark, sf)
    standing = d.filter("frontmatter is null and frontmatter_diagnostic_count > 0 and pmod(doc_id, 2) = 0").select("path", F.lit("document/frontmatter-unreadable").alias("kind"))
    other = d.select("path", F.lit("document/not-utf8").alias("kind"))  # a finding of a place explains nothing here
    return quarantine.unexplained(d, standing.unionByName(other)).select("path")


def m06_late(spark, sf):
    from vaultframe.streaming import watch

    late = watch.late_events(_docs(spark, sf).select("path", "generation", "content_hash"), table(spark, sf, "tombstones"))
    return late.groupBy("stale").agg(F.count(F.lit(1)).alias("events"))


def m09_batches(spark, sf):
    """Dirty roots: every folder of a dead path, coalesced to those no other covers."""
    from vaultframe.streaming import watch

    roots = table(spark, sf, "tombstones").select(F.regexp_replace("path", "/[^/]*$", "").alias("root"), F.lit(False).alias("gone"))
    return watch.coalesce_roots(roots)


def q01_repair(spark, sf):
    """The repair of every finding as an operation on its document, or why it is skipped."""
    defaults, replacements, folders = {"created": "2025-01-01"}, {"type": {"idea": "note", "Task": "task"}}, {"task": "tasks"}
    return plans.repair_plan(_found(spark, sf), _docs(spark, sf), defaults, replacements, folders).drop("ordinal")


def q02_still_holds(spark, sf):
    """A plan made of the generation before the last: operations on documents that changed since are stale."""
    d = _docs(spark, sf)
    made = d.agg(F.max("generation")).first()[0] - 1
    plan = plans.set_plan(d.filter(P.eq("type", "task")), fields={"status": "done"})
    return plans.still_holds(plan, d, made).select("path", "status", "reason")


def d08_new(spark, sf):
    """New documents by rule at every dead path and at some that are taken, allowed or not."""
    dead = table(spark, sf, "tombstones").select("path", F.when(F.pmod(F.length("path"), F.lit(3)) == 0, "log").when(F.pmod(F.length("path"), F.lit(3)) == 1, "note").alias("rule"))
    taken = _docs(spark, sf).filter("pmod(doc_id, 50) = 0").select("path", F.lit(None).cast("string").alias("rule"))
    made = _docs(spark, sf).filter("pmod(doc_id, 50) = 1").select(F.concat(F.lit("logs/n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("log").alias("rule"))
    asked = dead.unionByName(taken).unionByName(made).withColumn("fields", F.when(F.pmod(F.length("path"), F.lit(2)) == 0, '{"status":"someday"}'))
    return plans.new_plan(asked, _docs(spark, sf), {"log": {"target": "logs", "fields": {"type": "log", "status": "active"}}, "note": {"fields": {"type": "note"}}}, {"status": ["active", "done"]}, ["type"]).select("kind", "path", "new", "status", "reason")


def _planted_moves(spark, sf):
    """Every document into an archive, some under names that no wikilink can spell, some to a place that is taken."""
    d = _docs(spark, sf)
    to = F.when(F.pmod("doc_id", F.lit(7)) == 0, "house-style.md").when(F.pmod("doc_id", F.lit(5)) == 0, F.concat(F.lit("archive/a|b-"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("archive/"), F.col("path")))
    there = d.select("doc_id", "path", "suffix_key").unionByName(spark.createDataFrame([(-1, "house-style.md", "house-style/")], "doc_id bigint, path string, suffix_key string"))
    return d.select("path", to.alias("to")), there


def d09_move(spark, sf):
    moves, there = _planted_moves(spark, sf)
    return plans.move_forecast(moves, there, table(spark, sf, "links")).select("path", "to", "planned", "skipped", "files", "refusal")


def d09_move_plan(spark, sf):
    """The same moves as operations."""
    moves, there = _planted_moves(spark, sf)
    return plans.move_plan(moves, there, table(spark, sf, "links"))


def d10_delete(spark, sf):
    return plans.delete_forecast(_docs(spark, sf), table(spark, sf, "links"))


def d10_delete_plan(spark, sf):
    """Deleting what each wikilink target names: done, refused for its backlinks, ambiguous or not there."""
    targets = table(spark, sf, "links").filter("protocol is null and family = 'wikilink' and target <> ''").select("target").distinct()
    return plans.delete_plan(targets, _docs(spark, sf), table(spark, sf, "links")).select("path", "old", "status", "reason")


def d10_redirect_plan(spark, sf):
    """Deleting the documents of one folder, their backlinks redirected."""
    targets = _docs(spark, sf).filter("path like 'delta-%'").select(F.col("path").alias("target"))
    return plans.delete_plan(targets, _docs(spark, sf), table(spark, sf, "links"), rewrite_to="guides/style.md").filter("kind = 'rewrite_link'")


def d11_rewrite(spark, sf):
    return plans.rewrite_forecast(table(spark, sf, "links"), "house-style", "style-guide")


def d11_rewrite_plan(spark, sf):
    """The same as operations, those in the frontmatter told from those in the body."""
    return plans.rewrite_plan(table(spark, sf, "links"), _docs(spark, sf), "house-style", "style-guide")


def d12_applied(spark, sf):
    """What setting a field on tasks makes of their texts: the frontmatter read again."""
    tasks = _docs(spark, sf).filter(P.eq("type", "task"))
    out = plans.applied(plans.set_plan(tasks, fields={"status": "done"}), _docs(spark, sf)).filter("refusal is null")
    again = parse.parse(out.select("path", "text"), "path", "text").withColumn("frontmatter", F.col("frontmatter"))
    return again.select("path", P.raw("status").alias("status"), P.raw("type").alias("type"), F.sha2("body", 256).alias("body_hash"))


_S = "(frontmatter ->> '$.\"{0}\"')"
_J = "json_type(json_extract(frontmatter, '$.\"{0}\"'))"
_TERMS = r"terms AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+')) AS term FROM documents WHERE body IS NOT NULL)"
_HAS = "SELECT DISTINCT doc_id FROM terms WHERE term = '{}'"
_STR = "CASE {j} WHEN 'VARCHAR' THEN [{s}] WHEN 'ARRAY' THEN CAST(json_extract(frontmatter, '$.\"{f}\"') AS VARCHAR[]) ELSE CAST([] AS VARCHAR[]) END"


def _strings(f: str) -> str:
    return _STR.format(j=_J.format(f), s=_S.format(f), f=f)


def _of(code: str, subject: str, detail: str, where: str, source: str = "documents", severity: str = "warning") -> str:
    return f"SELECT '{code}' AS code, '{severity}' AS severity, path, {subject} AS subject, {detail} AS detail FROM {source} WHERE {where}"


_RULES = {
    "l05_required": _of("required-field-missing", "'created'", "NULL::VARCHAR", f"frontmatter IS NOT NULL AND {_S.format('created')} IS NULL"),
    "l06_allowed": _of("value-not-allowed", "'type'", "v", f"v NOT IN ({', '.join(repr(a) for a in ALLOWED)})", f"(SELECT path, unnest({_strings('type')}) AS v FROM documents)"),
    "l07_types": _of("field-type-invalid", "'due'", _S.format("due"), f"{_S.format('due')} IS NOT NULL AND NOT coalesce(regexp_full_match({_S.format('due')}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST({_S.format('due')} AS DATE) IS NOT NULL, false)"),
    "l08_length": _of("exceeds-max-length", "'title'", "length(v)::VARCHAR", "length(v) > 30", f"(SELECT path, unnest({_strings('title')}) AS v FROM documents)"),
    "l09_forbidden": _of("forbidden-field", "'zip'", _S.format("zip"), f"{_S.format('zip')} IS NOT NULL"),
    "l10_misrouted": _of("document-misrouted", "'task'", "'**/tasks/**'", f"{_S.format('type')} = 'task' AND NOT regexp_matches(path, '^(.*/)?tasks/.*$')"),
    "l12_unread": _of("frontmatter-parse-failed", "NULL::VARCHAR", "frontmatter_diagnostic_count::VARCHAR", "frontmatter IS NULL AND frontmatter_diagnostic_count > 0", severity="error"),
}
_SUFFIX = r"suffix AS (SELECT doc_id, path, array_to_string(segs[i:], '/') AS called FROM (SELECT doc_id, path, string_split(regexp_replace(path, '^(.*[^/])\.[^./]*$', '\1'), '/') AS segs FROM documents), LATERAL (SELECT unnest(range(1, len(segs) + 1)) AS i))"
_RED = r"regexp_replace({}, '^(.*[^/])\.[^./]*$', '\1')"
_WIKI = "wiki AS (SELECT DISTINCT document, ordinal, target FROM links WHERE protocol IS NULL AND family = 'wikilink' AND target <> '')"
_AMBIGUOUS = f"{_SUFFIX}, {_WIKI}, total AS (SELECT t.target, count(*) AS total FROM (SELECT DISTINCT target FROM wiki) t JOIN suffix s ON s.called = t.target OR s.called = {_RED.format('t.target')} GROUP BY 1 HAVING count(*) > 1)"
_LOG = "log AS (SELECT 'users/u' || user_id || '.md' AS path, max(event_id) AS seq, arg_max(CASE WHEN event_type = 'error' THEN 'death' ELSE 'upsert' END, event_id) AS kind, arg_max(props, event_id) AS frontmatter FROM events GROUP BY 1)"


def _naming() -> str:
    from vaultframe.queries.reads import _LINK, _THERE

    return f"""{_SUFFIX}, {_LINK}, {_THERE}, lone AS (SELECT called, min(path) AS path FROM suffix GROUP BY 1 HAVING count(*) = 1), naming AS (
  SELECT DISTINCT s.path, l.document, l.ordinal, l.family, l.target FROM link l JOIN lone s ON s.called = l.target OR s.called = {_RED.format('l.target')} WHERE family = 'wikilink' AND target <> ''
  UNION ALL SELECT d.path, t.document, t.ordinal, l.family, l.target FROM there t JOIN documents d ON d.path = t.there JOIN link l ON l.document = t.document AND l.ordinal = t.ordinal)"""


def _moved() -> str:
    """Moves and the links they meet, where a document `house-style.md` stands at the root besides."""
    names = _naming().replace("FROM documents), LATERAL", "FROM (SELECT doc_id, path FROM documents UNION ALL SELECT -1, 'house-style.md')), LATERAL")
    return rf"""{names}, moves AS (
  SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'house-style.md' WHEN doc_id % 5 = 0 THEN 'archive/a|b-' || doc_id || '.md' ELSE 'archive/' || path END AS "to", CASE WHEN doc_id % 7 = 0 THEN 'exists' END AS refusal FROM documents
), hit AS (SELECT n.*, "to", refusal, regexp_replace(string_split("to", '/')[-1], '^(.+)\.[^.]*$', '\1') AS stem, n.family = 'wikilink' AND contains("to", '|') AS skip FROM naming n JOIN moves USING (path))"""


def _p5() -> str:
    from vaultframe.queries.problems import _P5

    return _P5


_LINKS_FOUND = {
    "l01_links_missing": _p5() + " SELECT CASE missing_in WHEN 'documents' THEN 'link-target-missing' ELSE 'link-anchor-missing' END AS code, 'warning' AS severity, d.path, n.target AS subject, CASE WHEN missing_in = 'headings' THEN n.anchor END AS detail FROM orphan o JOIN named n ON n.document = o.document AND n.ordinal = o.ordinal JOIN documents d ON d.doc_id = o.document WHERE missing_in IS NOT NULL",
    "l03_block_missing": _p5() + r""", blocks AS (SELECT doc_id, unnest(regexp_extract_all(body, '(?m)(?:^|\s)\^([A-Za-z0-9_-]+)[ \t]*$', 1)) AS block FROM documents)
SELECT 'link-block-missing' AS code, 'warning' AS severity, d.path, l.target AS subject, l.block_ref AS detail FROM (SELECT DISTINCT document, ordinal, target, block_ref FROM links WHERE protocol IS NULL AND block_ref IS NOT NULL) l JOIN documents d ON d.doc_id = l.document
WHERE EXISTS (SELECT 1 FROM hits h WHERE h.document = l.document AND h.ordinal = l.ordinal) AND NOT EXISTS (SELECT 1 FROM hits h JOIN blocks b ON b.doc_id = h.doc_id AND b.block = l.block_ref WHERE h.document = l.document AND h.ordinal = l.ordinal)""",
    "l04_ambiguous": f"WITH {_AMBIGUOUS} SELECT 'link-ambiguous' AS code, 'warning' AS severity, d.path, w.target AS subject, total::VARCHAR AS detail FROM wiki w JOIN total USING (target) JOIN documents d ON d.doc_id = w.document",
    "l11_reference_type": rf"""
WITH {_SUFFIX}, lone AS (SELECT called, min(path) AS path FROM suffix GROUP BY 1 HAVING count(*) = 1),
ref AS (SELECT path, regexp_extract({_S.format('parent')}, '^!?\[\[([^\]|#]+)', 1) AS target FROM documents WHERE {_S.format('parent')} IS NOT NULL),
hit AS (SELECT DISTINCT r.path, r.target, l.path AS there FROM ref r JOIN lone l ON l.called = r.target OR l.called = {_RED.format('r.target')} WHERE r.target <> '')
SELECT 'reference-type' AS code, 'warning' AS severity, h.path, h.target AS subject, coalesce({_S.format('type')}, '(missing)') AS detail FROM hit h JOIN documents d ON d.path = h.there WHERE coalesce({_S.format('type')} NOT IN ('note', 'task', 'phase'), true)""",
}
_ALL = "found AS (" + " UNION ALL ".join(f"({q})" for q in [*_RULES.values(), *_LINKS_FOUND.values()]) + ")"
_KEY = r"regexp_replace({}, '^([^/]*/)+', '') || '/'"
_AS_RECORDS = rf"""
suffixed AS (SELECT path, suffix_key, array_to_string(segs[i:], '/') AS called FROM (SELECT path, suffix_key, string_split(regexp_replace(path, '^(.*[^/])\.[^./]*$', '\1'), '/') AS segs FROM documents), LATERAL (SELECT unnest(range(1, len(segs) + 1)) AS i)),
amb AS (SELECT DISTINCT subject FROM found WHERE code = 'link-ambiguous'),
cand AS (SELECT a.subject, s.path, s.suffix_key, row_number() OVER (PARTITION BY a.subject ORDER BY s.suffix_key, s.path) AS n FROM amb a JOIN suffixed s ON s.called = a.subject OR s.called = {_RED.format('a.subject')}),
heads AS (SELECT subject, count(*) AS total, string_agg(path || '=' || suffix_key, '|' ORDER BY n) FILTER (n <= 5) AS head FROM cand GROUP BY 1),
records AS (
  SELECT DISTINCT md5(concat_ws(chr(10), code, path, message)) AS id, code AS kind, severity, path, target, CASE WHEN code = 'link-ambiguous' THEN total ELSE 0 END AS candidates_total, message,
    CASE WHEN code = 'link-ambiguous' THEN head ELSE '' END AS candidates,
    CASE WHEN coalesce(target, '') = '' THEN '' ELSE array_to_string(list_sort(list_distinct([{_KEY.format('target')}, {_KEY.format(_RED.format('target'))}])), '|') END AS class_keys
  FROM (SELECT *, CASE WHEN code LIKE 'link-%' THEN subject END AS target, concat_ws(': ', code, subject, detail) AS message FROM found) LEFT JOIN heads USING (subject)
)"""


# FNV-1a of a token's bytes from the model's own state, finished, as a bucket of 64. All in 128-bit integers modulo 2 ** 64.
_M = "18446744073709551616::UHUGEINT"
_EMBED = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS tok FROM documents WHERE body IS NOT NULL),
own AS (SELECT list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform([4, 0, 0, 0, 0, 0, 0, 0, 115, 116, 117, 98, 1, 0, 0, 0, 0, 0, 0, 0, 50], lambda b: b::UHUGEINT)), lambda s, b: (xor(s, b) * 1099511628211::UHUGEINT) % {_M}) AS seed),
x AS (SELECT tok, hex(encode(tok)) AS h FROM (SELECT DISTINCT tok FROM t)),
f AS (
  SELECT tok, list_reduce(list_concat([seed], list_transform(range(1, len(h), 2), lambda i: (16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1)::UHUGEINT)), lambda s, b: (xor(s, b) * 1099511628211::UHUGEINT) % {_M}) AS v FROM x, own
  UNION ALL SELECT NULL, seed FROM own
), g AS (SELECT tok, xor(v, v >> 30::UHUGEINT) * 13787848793156543929::UHUGEINT % {_M} AS v FROM f), i AS (SELECT tok, xor(v, v >> 27::UHUGEINT) * 10723151780598845931::UHUGEINT % {_M} AS v FROM g), b AS (SELECT tok, (xor(v, v >> 31::UHUGEINT) % 64)::INT AS bucket FROM i),
c AS (SELECT doc_id, bucket, count(*) AS n FROM (SELECT doc_id, bucket FROM t JOIN b USING (tok) UNION ALL SELECT doc_id, bucket FROM documents, b WHERE tok IS NULL AND body IS NOT NULL) GROUP BY 1, 2),
v AS (SELECT doc_id, sqrt(sum(n * n))::FLOAT AS norm FROM c GROUP BY 1),
e AS (SELECT v.doc_id, list((coalesce(n, 0)::FLOAT / norm)::FLOAT ORDER BY k) AS embedding FROM v CROSS JOIN (SELECT unnest(range(64)) AS k) LEFT JOIN c ON c.doc_id = v.doc_id AND bucket = k GROUP BY 1)
SELECT d.doc_id, embedding FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id"""

ORACLES = {
    "v01_embed": _EMBED,
    "r16_vocabulary": f"WITH {_TERMS} SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM terms GROUP BY 1",
    "r21_match_and": f"WITH {_TERMS} {_HAS.format('short')} INTERSECT {_HAS.format('moss')}",
    "r21_match_or": f"WITH {_TERMS} {_HAS.format('moss')} UNION {_HAS.format('granero')}",
    "r21_match_not": f"WITH {_TERMS} {_HAS.format('moss')} EXCEPT {_HAS.format('river')}",
    "r21_match_phrase": r"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(strip_accents(lower(body)), '[\p{L}\p{N}]+'), ' ') || ' ', ' the moss ')",
    "v02_nearest": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 10",
    **_RULES,
    **_LINKS_FOUND,
    "a08_summary": f"""
WITH {_ALL}, facets AS (
  SELECT 'code' AS facet, code AS value FROM found UNION ALL SELECT 'severity', severity FROM found UNION ALL SELECT 'path_prefix', CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'root' END FROM found
  UNION ALL SELECT 'rule', CASE code WHEN 'required-field-missing' THEN 'created' WHEN 'value-not-allowed' THEN 'type' WHEN 'field-type-invalid' THEN 'due' WHEN 'document-misrouted' THEN 'tasks' END FROM found
  UNION ALL SELECT 'field', subject FROM found WHERE code IN ('required-field-missing', 'value-not-allowed', 'field-type-invalid', 'exceeds-max-length', 'forbidden-field')
  UNION ALL SELECT 'target', coalesce(subject, '(none)') FROM found WHERE code LIKE 'link-%' UNION ALL SELECT 'disallowed_value', detail FROM found WHERE code = 'value-not-allowed' UNION ALL SELECT 'invalid_type', subject FROM found WHERE code = 'field-type-invalid'
) SELECT facet, value, count(*) AS findings FROM facets WHERE value IS NOT NULL GROUP BY 1, 2""",
    "l14_triage": f"WITH {_ALL} SELECT code, path, subject FROM found WHERE (code LIKE 'forbidden-%' OR code LIKE 'link-a%' OR code = 'document-misrouted') AND severity = 'warning' AND regexp_matches(path, '^(delta|heron)-[^/]*/')",
    "r20_in_class": f"WITH {_ALL}, {_AS_RECORDS} SELECT kind, path, target, message FROM records WHERE ('|' || class_keys) LIKE '%|house-style/%'",
    "i06_class_discard": rf"""
WITH {_AMBIGUOUS}, dead AS (SELECT DISTINCT regexp_replace(regexp_replace(path, '^.*/', ''), '^(.+)\.[^.]*$', '\1') AS stem FROM tombstones)
SELECT w.target AS subject, count(*) AS findings FROM wiki w JOIN total USING (target) JOIN documents d ON d.doc_id = w.document
WHERE regexp_replace(w.target, '^.*/', '') NOT IN (SELECT stem FROM dead) AND regexp_replace({_RED.format('w.target')}, '^.*/', '') NOT IN (SELECT stem FROM dead) GROUP BY 1""",
    "i01_fold": f"WITH {_LOG} SELECT path, kind, seq, frontmatter FROM log",
    "i03_deaths": f"WITH {_LOG} SELECT path, last_content_hash, provenance, generation FROM tombstones WHERE path NOT IN (SELECT path FROM log WHERE kind = 'death') UNION ALL SELECT path, NULL, 'watcher-removal', 999 FROM log WHERE kind = 'death'",
    "i04_guard": r"""
SELECT CASE WHEN doc_id % 11 = 0 THEN replace(path, '/', '\') WHEN doc_id % 13 = 0 THEN '/' || path ELSE path END AS path, CASE WHEN doc_id % 11 = 0 AND contains(path, '/') THEN 'backslash' WHEN doc_id % 13 = 0 AND doc_id % 11 <> 0 THEN 'absolute' ELSE 'size' END AS reason
FROM documents WHERE body IS NOT NULL AND (doc_id % 11 = 0 AND contains(path, '/') OR doc_id % 13 = 0 AND doc_id % 11 <> 0 OR doc_id % 7 = 0)""",
    "i09_verify": r"""
WITH d AS (SELECT doc_id, path, body, byte_length, CASE WHEN doc_id % 97 = 0 THEN 'x' ELSE body_hash END AS body_hash, body_offset + (doc_id % 89 = 0)::INT AS body_offset, CASE WHEN doc_id % 83 = 0 THEN upper(suffix_key) ELSE suffix_key END AS suffix_key,
  CASE WHEN doc_id % 79 = 0 THEN frontmatter[:5] ELSE frontmatter END AS frontmatter, CASE WHEN doc_id % 73 = 0 THEN NULL ELSE frontmatter_projection_hash END AS h FROM documents WHERE doc_id % 101 <> 0),
b AS (SELECT *, array_to_string(list_reverse(list_concat(string_split(path, '/')[:-2], [regexp_replace(string_split(path, '/')[-1], '^(.+)\.[^.]*$', '\1')])), '/') || '/' AS k FROM d WHERE body IS NOT NULL)
SELECT 'body_hash' AS "check", count(*) FILTER (sha256(body) <> body_hash) AS offenders FROM b UNION ALL SELECT 'size', count(*) FILTER (body_offset + strlen(body) <> byte_length) FROM b
UNION ALL SELECT 'suffix_key', count(*) FILTER (k <> suffix_key) FROM b UNION ALL SELECT 'frontmatter_json', count(*) FILTER (frontmatter IS NOT NULL AND NOT json_valid(frontmatter)) FROM b
UNION ALL SELECT 'projection_hash', count(*) FILTER (sha256(frontmatter) IS DISTINCT FROM h) FROM b
UNION ALL SELECT 'link_family', count(*) FILTER (document % 71 = 0) FROM links UNION ALL SELECT 'heading_level', count(*) FILTER (document % 67 = 0) FROM headings UNION ALL SELECT 'tag_source', count(*) FILTER (document % 61 = 0) FROM document_tags
UNION ALL SELECT 'orphan_links', count(*) FROM links WHERE document NOT IN (SELECT doc_id FROM d) UNION ALL SELECT 'orphan_headings', count(*) FROM headings WHERE document NOT IN (SELECT doc_id FROM d) UNION ALL SELECT 'orphan_tags', count(*) FROM document_tags WHERE document NOT IN (SELECT doc_id FROM d)""",
    "m01_heal": "SELECT coalesce(d.path, t.path) AS path, CASE WHEN t.path IS NULL THEN 'derive' WHEN d.path IS NULL THEN 'prune' WHEN d.content_hash <> coalesce(t.last_content_hash, '') THEN 're-derive' ELSE 'keep' END AS action FROM documents d FULL JOIN tombstones t ON d.path = t.path",
    "m03_rederive": "SELECT path FROM documents WHERE frontmatter IS NULL AND frontmatter_diagnostic_count > 0 AND doc_id % 2 <> 0",
    "m06_late": "SELECT coalesce(t.generation >= d.generation AND t.last_content_hash IS NOT DISTINCT FROM d.content_hash, false) AS stale, count(*) AS events FROM documents d LEFT JOIN tombstones t ON t.path = d.path GROUP BY 1",
    "m09_batches": "WITH r AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM tombstones) SELECT root, false AS gone FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE starts_with(a.root, b.root || '/'))",
    "q01_repair": rf"""
WITH {_ALL}, alias AS (SELECT alias, min(path) AS meant FROM (SELECT DISTINCT path, unnest({_strings('aliases')}) AS alias FROM documents) GROUP BY 1 HAVING count(*) = 1),
o AS (
  SELECT code, f.path, subject, detail, meant, CASE WHEN code = 'document-misrouted' THEN 'tasks/' || string_split(f.path, '/')[-1] END AS there, CASE WHEN code = 'value-not-allowed' THEN CASE detail WHEN 'idea' THEN '"note"' WHEN 'Task' THEN '"task"' END END AS other
  FROM found f LEFT JOIN alias ON code = 'link-target-missing' AND alias = subject
)
SELECT CASE WHEN code = 'required-field-missing' THEN 'add_frontmatter' WHEN code IN ('value-not-allowed', 'field-type-invalid', 'exceeds-max-length', 'reference-type') THEN 'set_frontmatter' WHEN code = 'forbidden-field' THEN 'remove_frontmatter' WHEN code = 'document-misrouted' THEN 'move_document' ELSE 'rewrite_link' END AS kind, path,
  CASE WHEN code = 'link-target-missing' THEN 'wikilink' WHEN code <> 'document-misrouted' THEN subject END AS field, CASE WHEN code = 'link-target-missing' THEN subject ELSE detail END AS old,
  CASE WHEN code = 'required-field-missing' THEN '"2025-01-01"' WHEN code = 'link-target-missing' THEN regexp_replace(string_split(meant, '/')[-1], '^(.+)\.[^.]*$', '\1') ELSE coalesce(other, there) END AS new,
  CASE WHEN reason IS NULL THEN 'planned' ELSE 'skipped' END AS status, reason
FROM (SELECT *, CASE WHEN code IN ('frontmatter-parse-failed', 'link-anchor-missing', 'link-block-missing') THEN 'graph-diagnostic' WHEN code = 'link-ambiguous' THEN 'ambiguous-target' WHEN code IN ('field-type-invalid', 'exceeds-max-length', 'reference-type') OR code = 'value-not-allowed' AND other IS NULL THEN 'no-rule-matched'
  WHEN code = 'document-misrouted' AND there IN (SELECT path FROM documents) THEN 'destination-exists' WHEN code = 'link-target-missing' AND meant IS NULL THEN 'link-decision-needed' END AS reason FROM o)""",
    "q02_still_holds": f"SELECT path, CASE WHEN generation > (SELECT max(generation) - 1 FROM documents) AND {_S.format('status')} IS DISTINCT FROM 'done' THEN 'refused' WHEN {_S.format('status')} = 'done' THEN 'unchanged' ELSE 'planned' END AS status, CASE WHEN generation > (SELECT max(generation) - 1 FROM documents) AND {_S.format('status')} IS DISTINCT FROM 'done' THEN 'stale' END AS reason FROM documents WHERE {_S.format('type')} = 'task' AND {_J.format('type')} = 'VARCHAR'",
    "d08_new": """
WITH a AS (SELECT path, CASE length(path) % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'note' END AS rule FROM tombstones UNION ALL SELECT path, NULL FROM documents WHERE doc_id % 50 = 0 UNION ALL SELECT 'logs/n' || doc_id || '.md', 'log' FROM documents WHERE doc_id % 50 = 1),
b AS (SELECT *, length(path) % 2 = 0 AS someday, path IN (SELECT path FROM documents) AS taken FROM a),
c AS (SELECT *, CASE WHEN rule = 'note' THEN 'rule-not-creatable' WHEN rule = 'log' AND NOT starts_with(path, 'logs/') THEN 'outside-rule-target' WHEN taken THEN 'exists' WHEN someday THEN 'value-not-allowed' END AS reason FROM b)
SELECT 'create_document' AS kind, path, CASE WHEN rule = 'log' AND someday THEN '{"status":"someday","type":"log"}' WHEN rule = 'log' THEN '{"status":"active","type":"log"}' WHEN rule = 'note' AND someday THEN '{"status":"someday","type":"note"}' WHEN rule = 'note' THEN '{"type":"note"}' WHEN someday THEN '{"status":"someday"}' ELSE '{}' END AS new,
  CASE WHEN reason IS NULL THEN 'planned' ELSE 'refused' END AS status, coalesce(reason, CASE WHEN rule = 'log' OR someday THEN 'unknown-field' END) AS reason FROM c""",
    "d09_move": f"""
WITH {_moved()}, k AS (SELECT n.path, count(*) FILTER (NOT skip) AS planned, count(*) FILTER (skip) AS skipped, count(DISTINCT document) AS files FROM hit n GROUP BY 1)
SELECT m.path, "to", coalesce(planned, 0) AS planned, coalesce(skipped, 0) AS skipped, coalesce(files, 0) AS files, refusal FROM moves m LEFT JOIN k USING (path)""",
    "d09_move_plan": f"""
WITH {_moved()} SELECT 'move_document' AS kind, path, NULL AS field, path AS old, "to" AS new, NULL::INT AS ordinal, CASE WHEN refusal IS NULL THEN 'planned' ELSE 'refused' END AS status, refusal AS reason FROM moves
UNION ALL SELECT 'rewrite_link', d.path, n.family, n.target, CASE WHEN n.family = 'wikilink' THEN stem ELSE '/' || "to" END, n.ordinal, CASE WHEN skip THEN 'skipped' ELSE 'planned' END, CASE WHEN skip THEN 'unrepresentable-target' END FROM hit n JOIN documents d ON d.doc_id = n.document WHERE refusal IS NULL""",
    "d10_delete_plan": f"""
WITH {_naming()}, t AS (SELECT DISTINCT target FROM links WHERE protocol IS NULL AND family = 'wikilink' AND target <> ''),
f AS (SELECT t.target, list_sort(list(DISTINCT p) FILTER (p IS NOT NULL)) AS paths FROM t LEFT JOIN (SELECT t.target, s.path AS p FROM t JOIN suffix s ON s.called = t.target OR s.called = {_RED.format('t.target')} UNION SELECT t.target, d.path FROM t JOIN documents d ON d.path = t.target) x USING (target) GROUP BY 1),
k AS (SELECT n.path, count(*) AS backlinks FROM naming n JOIN documents d ON d.doc_id = n.document WHERE d.path <> n.path GROUP BY 1)
SELECT CASE WHEN len(paths) = 1 THEN paths[1] ELSE target END AS path, CASE WHEN len(paths) = 1 THEN paths[1] END AS old, CASE WHEN len(paths) = 1 AND backlinks IS NULL THEN 'planned' ELSE 'refused' END AS status,
  CASE WHEN coalesce(len(paths), 0) = 0 THEN 'target-not-found' WHEN len(paths) > 1 THEN 'ambiguous: ' || array_to_string(paths, ', ') WHEN backlinks > 0 THEN 'backlinks: ' || backlinks END AS reason FROM f LEFT JOIN k ON len(paths) = 1 AND k.path = paths[1]""",
    "d10_redirect_plan": f"""
WITH {_naming()} SELECT 'rewrite_link' AS kind, d.path, n.family AS field, n.target AS old, CASE WHEN n.family = 'wikilink' THEN 'style' ELSE '/guides/style.md' END AS new, n.ordinal, 'planned' AS status, NULL::VARCHAR AS reason FROM naming n JOIN documents d ON d.doc_id = n.document
WHERE n.path LIKE 'delta-%' AND d.path <> n.path AND n.path IN (SELECT path FROM suffix GROUP BY path HAVING bool_or(called = {_RED.format('path')} AND (SELECT count(*) FROM suffix o WHERE o.called = suffix.called) = 1))""",
    "d11_rewrite_plan": """
SELECT DISTINCT 'rewrite_link' AS kind, d.path, CASE WHEN encode(text)[span_offset + d.body_offset + 1 : span_offset + d.body_offset + CASE WHEN embed THEN 3 ELSE 2 END] = encode(CASE WHEN embed THEN '![[' ELSE '[[' END) THEN 'body' ELSE 'frontmatter' END AS field, 'house-style' AS old, 'style-guide' AS new, ordinal, 'planned' AS status, NULL::VARCHAR AS reason
FROM links l JOIN documents d ON d.doc_id = l.document WHERE family = 'wikilink' AND protocol IS NULL AND target = 'house-style'""",
    "d12_applied": f"SELECT path, 'done' AS status, {_S.format('type')} AS type, body_hash FROM documents WHERE {_S.format('type')} = 'task' AND {_J.format('type')} = 'VARCHAR' AND {_S.format('status')} IS DISTINCT FROM 'done'",
    "d10_delete": f"WITH {_naming()} SELECT d.path, count(n.path) AS backlinks, count(DISTINCT n.document) AS files, count(n.path) > 0 AS refused FROM documents d LEFT JOIN naming n ON n.path = d.path GROUP BY d.path",
    "d11_rewrite": "SELECT document, count(*) AS operations FROM (SELECT DISTINCT document, ordinal FROM links WHERE family = 'wikilink' AND protocol IS NULL AND target = 'house-style') GROUP BY 1",
}

QUERIES = {k: _rule(k) if k in _RULES else globals()[k] for k in ORACLES}
