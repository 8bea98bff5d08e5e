"""Plans: proposed changes as rows of one vocabulary, computed and not applied; `applied` makes texts of them.

An operation is (kind, path, field, old, new, ordinal, status, reason): `kind` is one of KINDS, `path` the document it changes, `field` a
frontmatter field or, for links, their family; `old` and `new` are JSON of a field, a path, or a link's target; `ordinal` is the link's.
`status` is planned, unchanged, skipped or refused, and `reason` says why of the last two, or warns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.operators import paths, predicates as P, reads, resolve
from vaultframe.plans import edits
from vaultframe.session import skew_join

KINDS = ["add_frontmatter", "set_frontmatter", "remove_frontmatter", "move_document", "delete_document", "create_document", "rewrite_link"]
OPERATION = "kind string, path string, field string, old string, new string, ordinal int, status string, reason string"
_COLUMNS = [c.split(" ")[0] for c in OPERATION.split(", ")]


class PlanRefused(ValueError):
    """The request itself makes no plan."""


def _operation(df: DataFrame, kind: Column | str, path: Column, status: Column | str = "planned", reason: Column | None = None, field: Column | None = None, old: Column | None = None, new: Column | None = None, ordinal: Column | None = None) -> DataFrame:
    text = lambda c: (F.lit(c) if c is None or isinstance(c, str) else c).cast("string")
    number = F.lit(None).cast("int") if ordinal is None else ordinal.cast("int")
    return df.select(text(kind).alias("kind"), path.alias("path"), text(field).alias("field"), text(old).alias("old"), text(new).alias("new"), number.alias("ordinal"), text(status).alias("status"), text(reason).alias("reason"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def representable(target: Column) -> Column:
    """Whether a name can be a wikilink's target as it is: no mark of the syntax, no line end, no white space at its edges."""
    return ~target.rlike(r"[\[\]|#\r\n]") & (F.trim(target) == target) & (target != "")


def _naming(documents: DataFrame, links: DataFrame) -> DataFrame:
    """(path, document, ordinal, family, target): links and the one document each names; ambiguous ones name none."""
    names = resolve.called(documents.select("doc_id", "path", "suffix_key"))
    single = names.groupBy("called").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).filter("n = 1").select(F.col("called").alias("form"), "path")
    wiki = resolve.plain(links, "family = 'wikilink' and target <> ''", "target")
    forms = wiki.select("document", "ordinal", "target", F.explode(paths.suffix_forms(F.col("target"))).alias("form"))
    by_suffix = skew_join(forms, single, "form", "inner").select("path", "document", "ordinal", F.lit("wikilink").alias("family"), "target").distinct()
    there = resolve.markdown_links(links, documents).select(F.col("there").alias("path"), "document", "ordinal", F.lit("markdown").alias("family"), "target")
    return by_suffix.unionByName(skew_join(there, documents.select("path"), "path", "left_semi").select("path", "document", "ordinal", "family", "target"))


def _rewrites(hit: DataFrame, documents: DataFrame, to: Column) -> DataFrame:
    """rewrite_link operations of links (document, ordinal, family, target) to the path `to`: a wikilink by its stem, skipped where that can't be
    written as one; a Markdown link from the root."""
    stem = paths.stem(F.element_at(paths.segments(to), -1))
    wiki = F.col("family") == "wikilink"
    homes = skew_join(hit, documents.select(F.col("doc_id").alias("document"), F.col("path").alias("home")), "document", "inner")
    skip = wiki & ~representable(stem)
    return _operation(homes, "rewrite_link", F.col("home"), F.when(skip, "skipped").otherwise("planned"), F.when(skip, "unrepresentable-target"), F.col("family"), F.col("target"), F.when(wiki, stem).otherwise(F.concat(F.lit("/"), to)), F.col("ordinal"))


def _moves(moves: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, to, refusal)."""
    there = documents.select(F.col("path").alias("to"), F.lit(True).alias("taken"))
    here = documents.select("path", F.lit(True).alias("known"))
    reason = F.when(F.col("known").isNull(), "missing").when(paths.refusal(F.col("to")).isNotNull(), paths.refusal(F.col("to"))).when(F.col("taken"), "exists")
    return skew_join(moves.join(here, "path", "left"), there, "to", "left").select("path", "to", reason.alias("refusal"))


def move_plan(moves: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """Operations of moves (path, to): the move, and a rewrite of each link that names the document alone. A refused move rewrites nothing."""
    checked = _moves(moves, documents)
    move = _operation(checked, "move_document", F.col("path"), F.when(F.col("refusal").isNull(), "planned").otherwise("refused"), F.col("refusal"), None, F.col("path"), F.col("to"))
    hit = skew_join(_naming(documents, links), checked.filter("refusal is null").select("path", "to"), "path", "inner")
    return move.unionByName(_rewrites(hit, documents, F.col("to")))


def move_forecast(moves: DataFrame, documents: DataFrame, links: DataFrame) -> DataFrame:
    """(path, to, planned, skipped, files, refusal) of moves (path, to): the links to rewrite, those whose new name can't be written as a
    wikilink, the files they're in, and why the move itself is refused, if it is."""
    stem = paths.stem(F.element_at(paths.segments(F.col("to")), -1))
    hit = skew_join(_naming(documents, links), moves, "path", "inner").withColumn("skip", (F.col("family") == "wikilink") & ~representable(stem))
    counts = hit.groupBy("path").agg(F.sum((~F.col("skip")).cast("bigint")).alias("planned"), F.sum(F.col("skip").cast("bigint")).alias("skipped"), F.count_distinct("document").alias("files"))
    zero = F.lit(0).cast("bigint")
    return _moves(moves, documents).join(counts, "path", "left").select("path", "to", *[F.coalesce(c, zero).alias(c) for c in ("planned", "skipped", "files")], "refusal")


def delete_plan(targets: DataFrame, documents: DataFrame, links: DataFrame, rewrite_to: str | None = None, allow_broken: bool = False) -> DataFrame:
    """Operations of deleting the documents that targets (target) name, each a path or a suffix that names one document; one that names several is
    refused with its candidates, one that names none as missing. While others link to it a document stays, unless the links may break or are
    redirected to the path `rewrite_to`."""
    names = resolve.called(documents.select("doc_id", "path", "suffix_key")).select("called", "path")
    forms = targets.select("target", F.explode(paths.suffix_forms(F.col("target"))).alias("called"))
    by_suffix = forms.join(names, "called").select("target", "path")
    by_path = targets.join(documents.select("path"), F.col("target") == F.col("path")).select("target", "path")
    found = targets.select("target").distinct().join(by_suffix.unionByName(by_path), "target", "left").groupBy("target").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    hit = skew_join(_naming(documents, links), found.filter("size(paths) = 1").select(F.col("paths")[0].alias("path")).distinct(), "path", "left_semi")
    own = documents.select(F.col("doc_id").alias("document"), F.col("path").alias("home"))
    hit = skew_join(hit, own, "document", "inner").filter("home <> path").drop("home")
    counts = hit.groupBy("path").agg(F.count(F.lit(1)).alias("backlinks"))
    judged = found.withColumn("path", F.when(F.size("paths") == 1, F.col("paths")[0])).join(counts, "path", "left")
    free = F.lit(allow_broken or rewrite_to is not None)
    reason = F.when(F.size("paths") == 0, "target-not-found").when(F.size("paths") > 1, F.concat(F.lit("ambiguous: "), F.array_join("paths", ", "))).when((F.col("backlinks") > 0) & ~free, F.concat(F.lit("backlinks: "), F.col("backlinks").cast("string")))
    gone = _operation(judged, "delete_document", F.coalesce("path", "target"), F.when(reason.isNull(), "planned").otherwise("refused"), reason, None, F.col("path"))
    return gone if rewrite_to is None else gone.unionByName(_rewrites(hit, documents, F.lit(rewrite_to)))


def delete_forecast(documents: DataFrame, links: DataFrame) -> DataFrame:
    """(path, backlinks, files, refused): what deleting each document would leave dangling; refused while anything links to it."""
    hit = _naming(documents, links).groupBy("path").agg(F.count(F.lit(1)).alias("backlinks"), F.count_distinct("document").alias("files"))
    zero = F.lit(0).cast("bigint")
    return documents.select("path").join(hit, "path", "left").select("path", F.coalesce("backlinks", zero).alias("backlinks"), F.coalesce("files", zero).alias("files"), F.coalesce(F.col("backlinks") > 0, F.lit(False)).alias("refused"))


def rewrite_plan(links: DataFrame, documents: DataFrame, target: str, to: str) -> DataFrame:
    """Operations on wikilinks spelled `target` to be spelled `to`; `field` tells those in the body from those in the frontmatter, by the bytes at
    their span. A name that can't be written as a target is refused."""
    asked = reads.newest(links.filter((F.col("family") == "wikilink") & F.col("protocol").isNull() & (F.col("target") == target)).select("document", "ordinal", "embed", "span_offset"), "document", "ordinal")
    held = asked.join(documents.select(F.col("doc_id").alias("document"), "path", "text", "body_offset"), "document")
    bytes_ = lambda start: F.expr(f"substring(cast(text as binary), cast({start} + 1 as int), 3)")
    opens = lambda b: F.when(F.col("embed"), b == F.lit(b"![[")).otherwise(F.substring(b, 1, 2) == F.lit(b"[["))
    in_body = opens(bytes_("span_offset + body_offset"))
    fine = edits.representable(to)
    return _operation(held, "rewrite_link", F.col("path"), "planned" if fine else "refused", None if fine else F.lit("unrepresentable-target"), F.when(in_body, "body").otherwise("frontmatter"), F.lit(target), F.lit(to), F.col("ordinal"))


def rewrite_forecast(links: DataFrame, target: str, to: str) -> DataFrame:
    """(document, operations): wikilinks spelled `target` to be spelled `to`. An unrepresentable name plans nothing."""
    asked = links.filter((F.col("family") == "wikilink") & F.col("protocol").isNull() & (F.col("target") == target)).select("document", "ordinal").distinct()
    return asked.filter(representable(F.lit(to))).groupBy("document").agg(F.count(F.lit(1)).alias("operations"))


def set_plan(documents: DataFrame, fields: dict | None = None, push: dict | None = None, pop: dict | None = None, remove: list[str] | None = None, allowed: dict[str, list] | None = None, known: list[str] | None = None, force: bool = False) -> DataFrame:
    """Operations on the frontmatter of each document: fields set to a value, values pushed to or popped from lists, fields removed. A field may be
    in one of these only. A value outside the field's allowed ones is refused unless forced; a field that isn't known is a warning."""
    classes = {"set": fields or {}, "push": push or {}, "pop": pop or {}, "remove": dict.fromkeys(remove or [])}
    for f in {f for c in classes.values() for f in c}:
        if sum(f in c for c in classes.values()) > 1:
            raise PlanRefused(f"'{f}' may be in only one of set, push, pop and remove")
    parts = []
    for how, wanted in classes.items():
        for field, value in wanted.items():
            old = _json(field)
            items = F.coalesce(P.strings(field), F.array().cast("array<string>"))
            if how == "set":
                new: Column = F.lit(None if value is None else json.dumps(value, ensure_ascii=False))
            elif how == "push":
                new = F.when(F.array_contains(items, str(value)), old).otherwise(F.to_json(F.concat(items, F.array(F.lit(str(value))))))
            elif how == "pop":
                new = F.when(F.array_contains(items, str(value)), F.to_json(F.filter(items, lambda x: x != F.lit(str(value))))).otherwise(old)
            else:
                new = F.lit(None).cast("string")
            bad = how in ("set", "push") and field in (allowed or {}) and value not in allowed[field] and not force
            kind = F.when(new.isNull(), "remove_frontmatter").when(old.isNull(), "add_frontmatter").otherwise("set_frontmatter")
            status = F.when(F.lit(bad), "refused").when(old.eqNullSafe(new), "unchanged").otherwise("planned")
            warning = F.lit("unknown-field" if known is not None and field not in known else None).cast("string")
            parts.append(_operation(documents, kind, F.col("path"), status, F.when(F.lit(bad), "value-not-allowed").otherwise(warning), F.lit(field), old, new))
    if not parts:
        raise PlanRefused("nothing to set")
    return together(*parts)


def _json(field: str) -> Column:
    """The field's value as JSON; null if absent or null."""
    raw = P.raw(field)
    return F.when(P.kind(field) == "STRING", F.to_json(F.array(raw)).substr(F.lit(2), F.length(F.to_json(F.array(raw))) - 2)).otherwise(raw)


def new_plan(proposed: DataFrame, documents: DataFrame, rules: dict[str, dict] | None = None, allowed: dict[str, list] | None = None, known: list[str] | None = None, force: bool = False) -> DataFrame:
    """Operations of new documents (path, rule, fields): `rule` may be null and `fields` JSON or null. A rule has a `target`, the folder that its
    documents go to, or makes none, and `fields` that a new one has unless it is given them. A path that is taken is refused unless forced, as is a
    value outside the allowed ones; a field that isn't known is a warning."""
    spark = proposed.sparkSession
    table = spark.createDataFrame([(n, r.get("target"), json.dumps(r.get("fields", {}))) for n, r in (rules or {}).items()] or [(None, None, None)], "rule string, target string, prefill string")
    there = documents.select("path", F.lit(True).alias("taken"))
    held = proposed.select("path", "rule", "fields").join(F.broadcast(table), "rule", "left").join(there, "path", "left")
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    given = as_map(F.col("fields"))
    merged = F.map_concat(F.map_filter(as_map(F.col("prefill")), lambda k, _: ~F.array_contains(F.map_keys(given), k)), given)
    sorted_ = F.map_from_entries(F.array_sort(F.map_entries(merged)))
    bad = F.lit(False)
    for f, values in (allowed or {}).items():
        bad = bad | F.coalesce(~F.try_element_at(merged, F.lit(f)).isin([str(v) for v in values]), F.lit(False))
    reason = (
        F.when(F.col("rule").isNotNull() & F.col("prefill").isNull(), "unknown-rule")
        .when(F.col("rule").isNotNull() & F.col("target").isNull(), "rule-not-creatable")
        .when(paths.refusal(F.col("path")).isNotNull(), paths.refusal(F.col("path")))
        .when(F.col("rule").isNotNull() & ~F.col("path").startswith(F.concat("target", F.lit("/"))), "outside-rule-target")
        .when(F.col("taken") & F.lit(not force), "exists")
        .when(bad & F.lit(not force), "value-not-allowed")
    )
    unknown = F.exists(F.map_keys(merged), lambda k: ~k.isin(known)) if known is not None else F.lit(False)
    return _operation(held, "create_document", F.col("path"), F.when(reason.isNull(), "planned").otherwise("refused"), F.coalesce(reason, F.when(unknown, F.lit("unknown-field"))), None, None, F.to_json(sorted_))


def new_forecast(proposed: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, refusal): whether a new document may be made at a path."""
    there = documents.select("path", F.lit(True).alias("taken"))
    return proposed.join(there, "path", "left").select("path", F.coalesce(paths.refusal(F.col("path")), F.when(F.col("taken"), "exists")).alias("refusal"))


#: Why a finding has no operation, by its code, where no rule could give it one.
SKIPPED = {"frontmatter-parse-failed": "graph-diagnostic", "link-anchor-missing": "graph-diagnostic", "link-block-missing": "graph-diagnostic", "link-ambiguous": "ambiguous-target"}


def repair_plan(findings: DataFrame, documents: DataFrame, defaults: dict[str, str] | None = None, replacements: dict[str, dict[str, str]] | None = None, folders: dict[str, str] | None = None) -> DataFrame:
    """Operations that repair findings (code, path, subject, detail), one row each: a missing field gets its default, a value that isn't allowed its
    replacement, a forbidden field goes, a misrouted document moves to its type's folder, and a link to nothing is rewritten to the one
    document that has its target as an alias. All else is skipped, with the reason."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in (d or {"": ""}).items() for x in kv])
    code, subject = F.col("code"), F.col("subject")
    default = pairs({f: json.dumps(v) for f, v in (defaults or {}).items()})[subject]
    replaced = pairs({f"{f}\u0000{old}": json.dumps(new) for f, m in (replacements or {}).items() for old, new in m.items()})[F.concat(subject, F.lit("\u0000"), F.coalesce("detail", F.lit("")))]
    to = F.concat(pairs(folders)[subject], F.lit("/"), F.element_at(paths.segments(F.col("path")), -1))
    alias = documents.select("path", F.explode(P.strings("aliases")).alias("target")).distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("meant")).filter("n = 1").drop("n")
    lost = findings.filter("code = 'link-target-missing'").withColumnRenamed("subject", "target")
    links = skew_join(lost, alias, "target", "left")
    stem = paths.stem(F.element_at(paths.segments(F.col("meant")), -1))
    rewrites = _operation(links, "rewrite_link", F.col("path"), F.when(F.col("meant").isNotNull(), "planned").otherwise("skipped"), F.when(F.col("meant").isNull(), "link-decision-needed"), F.lit("wikilink"), F.col("target"), stem)
    rest = findings.filter("code <> 'link-target-missing'")
    moved = skew_join(rest.withColumn("to", F.when(code == "document-misrouted", to)), documents.select(F.col("path").alias("to"), F.lit(True).alias("taken")), "to", "left")
    kind = (
        F.when(code == "required-field-missing", "add_frontmatter")
        .when(code.isin("value-not-allowed", "field-type-invalid", "exceeds-max-length", "reference-type"), "set_frontmatter")
        .when(code == "forbidden-field", "remove_frontmatter")
        .when(code == "document-misrouted", "move_document")
        .otherwise("rewrite_link")
    )
    reason = (
        F.when(code.isin(list(SKIPPED)), pairs(SKIPPED)[code])
        .when((code == "required-field-missing") & default.isNull(), "missing-default")
        .when((code == "value-not-allowed") & replaced.isNull(), "no-rule-matched")
        .when(code.isin("field-type-invalid", "exceeds-max-length", "reference-type"), "no-rule-matched")
        .when((code == "document-misrouted") & F.col("to").isNull(), "no-rule-matched")
        .when((code == "document-misrouted") & F.coalesce("taken", F.lit(False)), "destination-exists")
    )
    new = F.when(code == "required-field-missing", default).when(code == "value-not-allowed", replaced).when(code == "document-misrouted", F.col("to"))
    field = F.when(code != "document-misrouted", subject)
    return rewrites.unionByName(_operation(moved, kind, F.col("path"), F.when(reason.isNull(), "planned").otherwise("skipped"), reason, field, F.col("detail"), new))


def repair_summary(plan: DataFrame) -> DataFrame:
    """(kind, status, reason, operations)."""
    return plan.groupBy("kind", "status", "reason").agg(F.count(F.lit(1)).alias("operations"))


def still_holds(plan: DataFrame, documents: DataFrame, generation: int) -> DataFrame:
    """A plan made of generation `generation`, with planned operations on documents that changed since, or went, refused as stale."""
    now = documents.select("path", F.col("generation").alias("_now"))
    made = F.col("kind") == "create_document"
    stale = (F.col("status") == "planned") & ~made & (F.col("_now").isNull() | (F.col("_now") > generation))
    held = skew_join(plan, now, "path", "left")
    return held.withColumns({"reason": F.when(stale, "stale").otherwise(F.col("reason")), "status": F.when(stale, "refused").otherwise(F.col("status"))}).select(*_COLUMNS)


def applied(plan: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, to, text, refusal): what the planned operations make of the documents (path, text), a row for each one they touch: its new text, the
    path it has then (null if it is deleted), and why nothing of it holds, if so. All of a document's operations hold or none. Links are
    rewritten in the body by their spelling."""
    ops = plan.filter("status = 'planned'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "field", "old", "new"))).alias("ops"))
    held = ops.join(documents.select("path", "text"), "path", "left")

    def one(path: str, text: str | None, ops: list[dict]) -> tuple[str | None, str | None]:
        to: str | None = path
        for o in ops:
            if o["kind"] == "create_document":
                text = edits.render({k: v for k, v in json.loads(o["new"]).items()}, "")
                continue
            if text is None:
                raise edits.EditRefused("no such document")
            if o["kind"] == "delete_document":
                to = None
            elif o["kind"] == "move_document":
                to = o["new"]
            elif o["kind"] == "rewrite_link":
                if o["field"] != "markdown":
                    start = edits.frontmatter.read(text).body_start
                    body, _ = edits.rewrite_wikilinks(text[start:], o["old"], o["new"])
                    text = text[:start] + body
            else:
                text = edits.set_field(text, o["field"], None if o["new"] is None else json.loads(o["new"]))
        return to, text if to is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, mine, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    out.append((*one(path, text, mine), None))
                except (edits.EditRefused, ValueError) as e:
                    out.append((path, text, str(e)))
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], names=["path", "to", "text", "refusal"])

    return held.select("path", "ops", "text").mapInArrow(run, "path string, to string, text string, refusal string")
