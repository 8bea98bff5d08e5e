"""Queries of the parse operators over documents.text (inventory P). The oracle is the vault's own fact tables, late repeats dropped."""

from __future__ import annotations

from pyspark.sql import functions as F

from vaultframe.functions import markdown, parse
from vaultframe.session import table


def _parsed(spark, sf):
    return parse.parse(table(spark, sf, "documents"), "doc_id", "text")


def parse01_frontmatter(spark, sf):
    """Extraction, YAML 1.2 reading and canonical JSON (P1-P6)."""
    return _parsed(spark, sf).filter("status is not null").select("doc_id", "body_offset", "frontmatter", F.sha2("body", 256).alias("body_hash"))


def parse03_refusals(spark, sf):
    return _parsed(spark, sf).filter("frontmatter is null and frontmatter_diagnostic_count > 0").select("doc_id")


def parse09_headings(spark, sf):
    return parse.facts(_parsed(spark, sf), "doc_id", "headings")


def parse12_links(spark, sf):
    return parse.facts(_parsed(spark, sf), "doc_id", "links")


def parse18_tags(spark, sf):
    return parse.facts(_parsed(spark, sf), "doc_id", "tags")


def parse10_slugify(spark, sf):
    """Slugs of heading texts, JVM-side, before they are made unique."""
    heads = table(spark, sf, "headings").select("text").distinct()
    return heads.select("text", F.replace(F.regexp_replace(F.lower(F.trim("text")), r"[^\p{L}\p{N}\p{M}_\- ]", ""), F.lit(" "), F.lit("-")).alias("slug"))


def parse11_slug_dedupe(spark, sf):
    """Unique slugs from each document's heading texts in order."""
    from collections.abc import Iterator

    import pyarrow as pa

    heads = table(spark, sf, "headings").select("document", "ordinal", "text").distinct()
    lists = heads.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("h"))

    def issue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slugs = markdown.Slugs()
                rows += [(doc, x["ordinal"], slugs.issue(x["text"])) for x in h]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.string()))], names=["document", "ordinal", "slug"])

    return lists.mapInArrow(issue, "document bigint, ordinal int, slug string")


def parse16_protocols(spark, sf):
    """Protocol and fragment split of raw targets, JVM-side (P16, P17)."""
    raw = table(spark, sf, "links").filter("protocol is not null").select(F.concat("protocol", F.lit("://"), "target", F.when(F.col("anchor").isNotNull(), F.concat(F.lit("#"), "anchor")).otherwise("")).alias("raw"), "protocol", "target", "anchor").distinct()
    rest = F.regexp_extract("raw", r"(?s)^([a-z][a-z0-9+.-]*)://(.+)$", 2)
    return raw.select("raw", F.regexp_extract("raw", r"(?s)^([a-z][a-z0-9+.-]*)://(.+)$", 1).alias("protocol"), F.substring_index(rest, "#", 1).alias("target"), F.when(F.instr(rest, "#") > 0, F.regexp_replace(rest, "(?s)^[^#]*#", "")).alias("anchor"))


def s06_hash(spark, sf):
    docs = table(spark, sf, "documents").filter("text is not null")
    return docs.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("bigint").alias("byte_length"))


ORACLES = {
    "parse01_frontmatter": "SELECT doc_id, body_offset, frontmatter, body_hash FROM documents WHERE text IS NOT NULL",
    "parse03_refusals": "SELECT doc_id FROM documents WHERE frontmatter IS NULL AND frontmatter_diagnostic_count > 0",
    "parse09_headings": "SELECT DISTINCT * FROM headings",
    "parse12_links": "SELECT DISTINCT * FROM links",
    "parse18_tags": "SELECT DISTINCT * FROM document_tags",
    "parse10_slugify": r"SELECT DISTINCT text, replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}\p{M}_\- ]', '', 'g'), ' ', '-') AS slug FROM headings",
    "parse11_slug_dedupe": "SELECT DISTINCT document, ordinal, slug FROM headings",
    "parse16_protocols": "SELECT DISTINCT protocol || '://' || target || coalesce('#' || anchor, '') AS raw, protocol, target, anchor FROM links WHERE protocol IS NOT NULL",
    "s06_hash": "SELECT doc_id, content_hash, byte_length FROM documents WHERE text IS NOT NULL",
}

QUERIES = {k: globals()[k] for k in ORACLES}
