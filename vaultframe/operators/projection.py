"""Projection of documents: frontmatter fields by name, and what the vault knows of a document by names that begin with a dot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.operators import paths, predicates as P, reads, resolve

COLUMNS = [".path", ".stem", ".frontmatter", ".headings", ".outgoing_links", ".unresolved_links", ".incoming_links", ".body", ".document_hash"]


def project(documents: DataFrame, columns: list[str], links: DataFrame | None = None, headings: DataFrame | None = None, blocks: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The documents' columns, in order, and the names that are unknown, which warn and take no row away. A bare name is a frontmatter key, as text.
    `.headings` lists the headings' texts, `.outgoing_links` and `.unresolved_links` targets in order of appearance, `.incoming_links` the
    paths of other documents whose links name this one alone. Only what is asked for is joined."""
    unknown = [c for c in columns if c.startswith(".") and c not in COLUMNS]
    asked = [c for c in dict.fromkeys(columns) if c not in unknown]
    df = documents
    empty = F.array().cast("array<string>")

    def listed(rows: DataFrame, name: str) -> DataFrame:
        """rows: (doc_id, at, value)"""
        lists = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(name))
        return df.join(lists, "doc_id", "left").withColumn(name, F.coalesce(F.col(f"`{name}`"), empty))

    if ".headings" in asked:
        df = listed(reads.newest(headings.select("document", "ordinal", "text"), "document", "ordinal").select(F.col("document").alias("doc_id"), F.col("ordinal").alias("at"), F.col("text").alias("value")), ".headings")
    target = reads.newest(links.select("document", "ordinal", "target"), "document", "ordinal") if links is not None else None
    if ".outgoing_links" in asked:
        df = listed(target.select(F.col("document").alias("doc_id"), F.col("ordinal").alias("at"), F.col("target").alias("value")), ".outgoing_links")
    if ".unresolved_links" in asked:
        lost = resolve.outcomes(links, documents, headings, blocks).filter("reason is not null").join(target, ["document", "ordinal"])
        df = listed(lost.select(F.col("document").alias("doc_id"), F.col("ordinal").alias("at"), F.col("target").alias("value")), ".unresolved_links")
    if ".incoming_links" in asked:
        single = resolve.naming(links, documents).groupBy("document", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("to")).filter("n = 1 and to <> document").select("document", "to").distinct()
        homes = single.join(documents.select(F.col("doc_id").alias("document"), F.col("path").alias("value")), "document")
        df = listed(homes.select(F.col("to").alias("doc_id"), F.col("value").alias("at"), "value"), ".incoming_links")
    given = {".path": F.col("path"), ".stem": paths.stem(F.element_at(paths.segments(F.col("path")), -1)), ".frontmatter": F.col("frontmatter"), ".body": F.col("body"), ".document_hash": F.col("content_hash")}
    return df.select(*[(given.get(c) if c in given else F.col(f"`{c}`") if c.startswith(".") else P.raw(c)).alias(c) for c in asked]), unknown
