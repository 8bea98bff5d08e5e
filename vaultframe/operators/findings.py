"""Findings: statements that a vault's state is wrong, in one shape (code, severity, path, subject, detail), their classes and summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.operators import orphans, paths, predicates as P, reads, resolve
from vaultframe.session import materialize, skew_join

COLUMNS = ["code", "severity", "path", "subject", "detail"]


def _finding(df: DataFrame, code: str, subject: Column, detail: Column, severity: str = "warning") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "path", subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def required(documents: DataFrame, field: str) -> DataFrame:
    return _finding(documents.filter("frontmatter is not null").filter(P.missing(field)), "required-field-missing", F.lit(field), F.lit(None))


def not_allowed(documents: DataFrame, field: str, allowed: list[str]) -> DataFrame:
    """Lists are checked element by element: a finding for each value outside the list."""
    bad = documents.select("path", F.explode(P.strings(field)).alias("v")).filter(~F.col("v").isin(allowed))
    return _finding(bad, "value-not-allowed", F.lit(field), F.col("v"))


def wrong_type(documents: DataFrame, field: str, kind: str) -> DataFrame:
    """Declared types: date, datetime, list_of_strings."""
    value = P.raw(field)
    if kind == "list_of_strings":
        fine = P.kind(field) == "ARRAY<STRING>"
    elif kind == "date":
        fine = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    else:
        fine = P.date(field).isNotNull() & value.rlike("^.{10}[T ]")
    return _finding(documents.filter(P.has(field) & ~F.coalesce(fine, F.lit(False))), "field-type-invalid", F.lit(field), value)


def too_long(documents: DataFrame, field: str, most: int) -> DataFrame:
    long = documents.select("path", F.explode(P.strings(field)).alias("v")).filter(F.char_length("v") > most)
    return _finding(long, "exceeds-max-length", F.lit(field), F.char_length("v"))


def forbidden(documents: DataFrame, field: str) -> DataFrame:
    return _finding(documents.filter(P.has(field)), "forbidden-field", F.lit(field), P.raw(field))


def misrouted(documents: DataFrame, type_: str, glob: str) -> DataFrame:
    return _finding(documents.filter(P.eq("type", type_) & ~P.path_glob(glob)), "document-misrouted", F.lit(type_), F.lit(glob))


def unread(documents: DataFrame) -> DataFrame:
    return _finding(documents.filter("frontmatter is null and frontmatter_diagnostic_count > 0"), "frontmatter-parse-failed", F.lit(None), F.col("frontmatter_diagnostic_count"), "error")


def links_missing(links: DataFrame, documents: DataFrame, headings: DataFrame) -> DataFrame:
    """link-target-missing and link-anchor-missing."""
    lost = materialize(orphans.orphan_links(links, documents, headings).join(reads.newest(links.select("document", "ordinal", "target", "anchor"), "document", "ordinal"), ["document", "ordinal"]), "lost")
    named = skew_join(lost, documents.select(F.col("doc_id").alias("document"), "path"), "document", "inner")
    code = F.when(F.col("missing_in") == "documents", "link-target-missing").otherwise("link-anchor-missing")
    return named.select(code.alias("code"), F.lit("warning").alias("severity"), "path", F.col("target").alias("subject"), F.when(F.col("missing_in") == "headings", F.col("anchor")).alias("detail"))


def block_missing(links: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """link-block-missing: a link, of either family, whose target names documents of which none has the block it asks for. An empty target
    is the link's own document. A target that names nothing is link-target-missing instead."""
    lost = materialize(resolve.blocks_missing(links, blocks, documents), "lost")
    return _finding(skew_join(lost, documents.select(F.col("doc_id").alias("document"), "path"), "document", "inner"), "link-block-missing", F.col("target"), F.col("block_ref"))


def ambiguous(links: DataFrame, documents: DataFrame) -> DataFrame:
    """link-ambiguous: a suffix link with more than one candidate. Candidates are counted by distinct target."""
    several = resolve.candidates(links, documents).filter("total > 1").select("target", "total")
    asked = resolve.plain(links, "family = 'wikilink' and target <> ''", "target")
    hit = skew_join(materialize(skew_join(asked, several, "target", "inner"), "ambiguous"), documents.select(F.col("doc_id").alias("document"), "path"), "document", "inner")
    return _finding(hit, "link-ambiguous", F.col("target"), F.col("total"))


def reference_type(documents: DataFrame, field: str, types: list[str]) -> DataFrame:
    """reference-type: a field's wikilink names exactly one document, and its type isn't one of `types`."""
    inner = F.regexp_extract(F.coalesce(P.raw(field), F.lit("")), r"^!?\[\[([^\]|#]+)", 1)
    refs = documents.select("path", inner.alias("target")).filter("target <> ''").select("path", "target", F.explode(paths.suffix_forms(F.col("target"))).alias("called"))
    names = resolve.called(documents.select("doc_id", "path", "suffix_key")).select("called", F.col("path").alias("there"))
    one = names.groupBy("called").agg(F.count(F.lit(1)).alias("n"), F.min("there").alias("there")).filter("n = 1").drop("n")
    kinds = documents.select(F.col("path").alias("there"), P.raw("type").alias("type"))
    hit = refs.join(one, "called").select("path", "target", "there").distinct().join(kinds, "there").filter(~F.coalesce(F.col("type").isin(types), F.lit(False)))
    return _finding(hit, "reference-type", F.col("target"), F.coalesce("type", F.lit("(missing)")))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def triage(findings: DataFrame, codes: list[str] | None = None, severities: list[str] | None = None, paths_: list[str] | None = None, subjects: list[str] | None = None) -> DataFrame:
    """Findings that pass every kind of filter given, each by any of its values: codes and paths are globs."""
    some = lambda c, globs: reduce(lambda a, b: a | b, [c.rlike("(?s)" + P.glob_regex(g)) for g in globs])
    out = findings
    if codes:
        out = out.filter(some(F.col("code"), codes))
    if severities:
        out = out.filter(F.col("severity").isin(severities))
    if paths_:
        out = out.filter(some(F.col("path"), paths_))
    if subjects:
        out = out.filter(F.col("subject").isin(subjects))
    return out


#: The subject of a rule about a field is the field's name; of a link it is the target.
_FIELD_CODES = ["required-field-missing", "value-not-allowed", "field-type-invalid", "exceeds-max-length", "forbidden-field"]


def summary(findings: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(facet, value, findings), all facets in one pass: code, severity, rule (by `rules`, from code to the rule's name), field, target,
    disallowed_value, invalid_type and path_prefix (the first path segment, 'root' at the top). A finding counts in the facets it has."""
    prefix = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("root")
    code, of_field = F.col("code"), F.col("code").isin(_FIELD_CODES)
    named = F.create_map(*[F.lit(x) for kv in (rules or {"": ""}).items() for x in kv])[code]
    values = {
        "code": code, "severity": F.col("severity"), "rule": named, "field": F.when(of_field, F.col("subject")), "target": F.when(code.startswith("link-"), F.coalesce("subject", F.lit("(none)"))),
        "disallowed_value": F.when(code == "value-not-allowed", F.col("detail")), "invalid_type": F.when(code == "field-type-invalid", F.col("subject")), "path_prefix": prefix,
    }
    facets = F.filter(F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("value")) for n, c in values.items()]), lambda f: f["value"].isNotNull())
    return findings.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("findings"))


#: A stored finding. `id` is a hash of what the finding says, so the same finding has the same id wherever it is derived.
RECORD = (
    "id string, fingerprint string, generation bigint, kind string, severity string, path string, target string, candidates_total bigint, "
    "candidates array<struct<path:string,suffix:string>>, class_keys array<string>, message string, detail string"
)


def records(found: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Findings as they are stored, but for fingerprint and generation: the class keys of link findings, and of ambiguous ones the head of
    candidates by `heads` (target, total, head). Equal findings of one path are one record."""
    link = F.col("code").startswith("link-")
    target = F.when(link, F.col("subject"))
    out = materialize(found, "found").withColumn("target", target).withColumn("class_keys", F.when(link & (F.coalesce("subject", F.lit("")) != ""), class_keys(F.col("subject"))).otherwise(F.array().cast("array<string>")))
    if heads is not None:
        out = skew_join(out, heads.select("target", "total", "head"), "target", "left")
    else:
        out = out.withColumns({"total": F.lit(None).cast("bigint"), "head": F.lit(None).cast("array<string>")})
    several = F.col("code") == "link-ambiguous"
    message = F.concat_ws(": ", "code", F.when(~link, F.col("subject")), target, "detail")
    shaped = out.select(
        F.col("code").alias("kind"), "severity", "path", "target",
        F.when(several, F.coalesce("total", F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")).alias("candidates_total"),
        F.when(several & F.col("head").isNotNull(), F.transform("head", lambda p: F.struct(p.alias("path"), paths.suffix_key(p).alias("suffix")))).otherwise(F.array().cast("array<struct<path:string,suffix:string>>")).alias("candidates"),
        "class_keys", message.alias("message"), "detail",
    ).distinct()
    return shaped.select(F.md5(F.concat_ws("\n", "kind", "path", "message")).alias("id"), "*")


def refused(heads: DataFrame) -> DataFrame:
    """Of (target, total, head) rows those that can't be recorded: a head of more than HEAD candidates, or of more than there are."""
    return heads.filter((F.size("head") > resolve.HEAD) | (F.size("head") > F.col("total")))


def prune(findings: DataFrame, walked: DataFrame, accounted: DataFrame) -> DataFrame:
    """The findings that stay after a clean walk of the roots `walked` (root): those outside them, and those whose path the walk
    accounted for (path). A root that wasn't walked cleanly isn't in `walked`, so nothing goes by absence alone. Paths are judged, not
    findings: a path is one row however many findings it has."""
    segs = F.split("path", "/")
    above = findings.select("path").distinct().select("path", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.concat_ws("/", F.slice(segs, 1, n))))).alias("root"))
    gone = above.join(walked.select("root"), "root", "left_semi").select("path").distinct().join(accounted.select("path"), "path", "left_anti")
    return findings.join(gone, "path", "left_anti")


def class_keys(target: Column) -> Column:
    """The ambiguity classes a suffix target belongs to: 'stem/' of each spelling it probes."""
    return F.array_distinct(F.transform(paths.suffix_forms(target), lambda t: F.concat(F.element_at(F.split(t, "/", -1), -1), F.lit("/"))))


def affected_classes(changed: DataFrame) -> DataFrame:
    """(class_key): the classes that changes to `path` touch, deaths included."""
    return changed.select(paths.class_key(F.col("path")).alias("class_key")).distinct()


def discard_classes(findings: DataFrame, classes: DataFrame) -> DataFrame:
    """Findings on a target none of whose classes is affected. Targets are judged, not findings."""
    targets = findings.filter("subject is not null").select("subject").distinct()
    hit = targets.select("subject", F.explode(class_keys(F.col("subject"))).alias("class_key")).join(classes, "class_key", "left_semi").select("subject").distinct()
    return findings.join(hit, "subject", "left_anti")


def withheld(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Findings that are to be recorded: those of a place (by kind) are withheld while a document stands at the place they are rendered at."""
    place = F.col("kind").isin("document/path-refused", "document/path-not-utf8", "document/not-utf8")
    return findings.filter(~place).unionByName(findings.filter(place).join(documents.select("path"), "path", "left_anti"))
