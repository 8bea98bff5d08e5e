"""Resolution of links over whole tables, without ever pairing all links of a target with all its candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.operators import orphans, paths, reads
from vaultframe.session import materialize, skew_join

HEAD = 5


def plain(links: DataFrame, condition: str, *columns: str) -> DataFrame:
    """(document, ordinal, columns) of the links without a protocol that meet a condition, each once."""
    return reads.newest(links.filter(f"protocol is null and {condition}").select("document", "ordinal", *columns), "document", "ordinal")


def mode(df: DataFrame) -> DataFrame:
    """Adds `resolution`: protocol first, family second."""
    return df.withColumn("resolution", F.when(F.col("protocol").isNotNull(), "protocol").when(F.col("family") == "wikilink", "suffix").otherwise("relative"))


def called(documents: DataFrame) -> DataFrame:
    """(called, path, suffix_key, doc_id): every suffix a document answers to."""
    return documents.select("doc_id", "path", "suffix_key", F.explode(paths.suffixes(F.col("path"))).alias("called"))


def suffix_links(links: DataFrame) -> DataFrame:
    """(document, ordinal, form): suffix links, one row for each spelling they probe."""
    asked = plain(links, "family = 'wikilink' and target <> ''", "target")
    return asked.select("document", "ordinal", F.explode(paths.suffix_forms(F.col("target"))).alias("form"))


def markdown_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, ordinal, target, anchor, there): Markdown links and the vault path they name, null above the root."""
    asked = plain(links, "family = 'markdown' and target <> ''", "target", "anchor")
    home = documents.select(F.col("doc_id").alias("document"), F.col("path").alias("home"))
    return skew_join(asked, home, "document", "inner").select("document", "ordinal", "target", "anchor", paths.relative(F.col("home"), F.col("target")).alias("there"))


def backlinks(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, backlinks): how many links name each document. Links are counted by what they call first, so a target held by a third of
    all links is one row when it meets the documents."""
    asked = suffix_links(links).groupBy(F.col("form").alias("called")).agg(F.count(F.lit(1)).alias("n"))
    by_suffix = called(documents).select("path", "called").join(asked, "called").select("path", "n")
    by_path = markdown_links(links, documents).filter("there is not null").groupBy(F.col("there").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    own = links.filter("protocol is null and target = ''").select("document", "ordinal").distinct().groupBy(F.col("document").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    itself = own.join(documents.select("doc_id", "path"), "doc_id").select("path", "n")
    found = by_suffix.unionByName(by_path.join(documents.select("path"), "path", "left_semi").select("path", "n")).unionByName(itself)
    counts = found.groupBy("path").agg(F.sum("n").alias("backlinks"))
    return documents.select("path").join(counts, "path", "left").select("path", F.coalesce("backlinks", F.lit(0).cast("bigint")).alias("backlinks"))


def candidates(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(target, total, head): for each distinct suffix target its number of candidates and the first HEAD paths in ladder order."""
    targets = links.filter("protocol is null and family = 'wikilink' and target <> ''").select("target").distinct()
    forms = targets.select("target", F.explode(paths.suffix_forms(F.col("target"))).alias("called"))
    ladder = Window.partitionBy("called").orderBy("suffix_key", "path")
    names = called(documents)
    totals = names.groupBy("called").agg(F.count(F.lit(1)).alias("total"))
    heads = names.withColumn("n", F.row_number().over(ladder)).filter(F.col("n") <= HEAD).groupBy("called").agg(F.collect_list(F.struct("suffix_key", "path")).alias("head"))
    each = forms.join(totals, "called", "left").join(heads, "called", "left")
    merged = each.groupBy("target").agg(F.coalesce(F.sum("total"), F.lit(0).cast("bigint")).alias("total"), F.array_sort(F.flatten(F.collect_list("head"))).alias("head"))
    return merged.select("target", "total", F.transform(F.slice("head", 1, HEAD), lambda c: c["path"]).alias("head"))


def minimal_suffix(documents: DataFrame) -> DataFrame:
    """(path, minimal): the shortest suffix key that names this document alone; null if even the whole key names another."""
    keys = documents.select("path", F.posexplode(paths.minimal_suffix_keys(F.col("path"))).alias("depth", "key"))
    alone = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("depth", "path")).alias("one")).filter("n = 1")
    best = alone.groupBy(F.col("one.path").alias("path")).agg(F.min(F.struct(F.col("one.depth").alias("depth"), "key")).alias("m"))
    return documents.select("path").join(best, "path", "left").select("path", F.col("m.key").alias("minimal"))


#: Why a link resolves to no one document.
REASONS = ["target-missing", "ambiguous", "anchor-missing", "block-ref-missing"]


def naming(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, ordinal, doc_id): every document that a link of either family names, one row each; an empty target is the link's own document.
    Distinct targets meet the documents first, so a target's candidates are found once, however many links have it."""
    keyed = orphans.link_keys(reads.newest(links.filter("protocol is null").select("document", "ordinal", "family", "protocol", "target", "anchor"), "document", "ordinal"), documents)
    asks = materialize(keyed.select("document", "ordinal", F.explode("target_keys").alias("key")), "asks")
    named = orphans.document_keys(documents).select("doc_id", F.explode("keys").alias("key"))
    each = asks.select("key").distinct().join(named, "key").groupBy("key").agg(F.collect_list("doc_id").alias("ids"))
    return skew_join(asks, each, "key", "inner").select("document", "ordinal", F.explode("ids").alias("doc_id")).distinct()


def outcomes(links: DataFrame, documents: DataFrame, headings: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(document, ordinal, total, reason): how each link without a protocol resolves: the number of documents it names, and the first of
    REASONS that holds, null if it names one document and the anchor or block it asks for is in it."""
    once = reads.newest(links.filter("protocol is null").select("document", "ordinal", "family", "protocol", "target", "anchor", "block_ref"), "document", "ordinal")
    keyed = materialize(orphans.link_keys(once, documents).select("document", "ordinal", F.explode("target_keys").alias("key")), "asks")
    totals = orphans.document_keys(documents).select("doc_id", F.explode("keys").alias("key"))
    counts = keyed.select("key").distinct().join(totals, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # the spellings a target probes name disjoint documents: a path's own name with the extension dropped is one string
    named = skew_join(keyed, counts, "key", "inner").groupBy("document", "ordinal").agg(F.sum("n").alias("total"))
    lost = orphans.orphan_links(links, documents, headings).filter("missing_in = 'headings'").select("document", "ordinal", F.lit(True).alias("no_anchor"))
    out = once.select("document", "ordinal").join(named, ["document", "ordinal"], "left").join(lost, ["document", "ordinal"], "left")
    missing_block = F.lit(False)
    if blocks is not None:
        out = out.join(blocks_missing(links, blocks, documents).select("document", "ordinal", F.lit(True).alias("no_block")), ["document", "ordinal"], "left")
        missing_block = F.coalesce("no_block", F.lit(False))
    total = F.coalesce("total", F.lit(0).cast("bigint"))
    reason = F.when(total == 0, REASONS[0]).when(total > 1, REASONS[1]).when(F.coalesce("no_anchor", F.lit(False)), REASONS[2]).when(missing_block, REASONS[3])
    return out.select("document", "ordinal", total.alias("total"), reason.alias("reason"))


def anchors(links: DataFrame, documents: DataFrame, headings: DataFrame) -> DataFrame:
    """(document, ordinal, family, verdict) of the links with an anchor: 'found' if a document they name has it, a wikilink's as a heading's text, a
    Markdown link's as a slug; else 'anchor-missing' or 'target-missing'."""
    asked = plain(links, "anchor is not null", "family")
    lost = orphans.orphan_links(links, documents, headings)
    verdict = F.when(F.col("missing_in") == "headings", "anchor-missing").when(F.col("missing_in") == "documents", "target-missing").otherwise("found")
    return asked.join(lost, ["document", "ordinal"], "left").select("document", "ordinal", "family", verdict.alias("verdict"))


def blocks_missing(links: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, ordinal, target, block_ref): links, of either family, whose target names documents of which none has the block they ask for."""
    asking = reads.newest(links.filter("protocol is null and block_ref is not null").select("document", "ordinal", "family", "protocol", "target", "anchor", "block_ref"), "document", "ordinal")
    keyed = orphans.link_keys(asking, documents).select("document", "ordinal", F.explode("target_keys").alias("key"))
    asks = materialize(keyed.join(asking.select("document", "ordinal", "target", "block_ref"), ["document", "ordinal"]), "asks")
    named = orphans.document_keys(documents)
    known = named.select(F.explode("keys").alias("key")).distinct()
    held = blocks.select(F.col("document").alias("doc_id"), F.col("block_id").alias("block_ref")).distinct().join(named, "doc_id")
    held = held.select(F.explode("keys").alias("key"), "block_ref").distinct().withColumn("held", F.lit(1))
    each = skew_join(asks.select("key", "block_ref").distinct(), known, "key", "inner").join(held, ["key", "block_ref"], "left")
    asked = F.concat(F.length("key").cast("string"), F.lit(":"), "key", "block_ref").alias("asked")  # a target key and a block id as one key
    verdict = each.select(asked, F.coalesce("held", F.lit(0)).alias("held"))
    found = skew_join(asks.select("document", "ordinal", "target", "block_ref", asked), verdict, "asked", "inner")
    return found.groupBy("document", "ordinal", "target", "block_ref").agg(F.max("held").alias("held")).filter("held = 0").drop("held")


def links_to(links: DataFrame, documents: DataFrame, targets: list[str]) -> DataFrame:
    """(doc_id): documents with an outgoing link, of either family, to each of the targets. A target is a path, or else a suffix that names
    one document; suffixes and links that name several resolve to none. The targets are a request's, so they're broadcast."""
    spark = documents.sparkSession
    asked = spark.createDataFrame([(t,) for t in sorted(set(targets))], "asked string")
    forms = asked.select("asked", F.explode(paths.suffix_forms(F.col("asked"))).alias("called"))
    by_suffix = called(documents).join(F.broadcast(forms), "called").select("asked", "doc_id")
    by_path = documents.join(F.broadcast(asked.withColumn("path", F.col("asked"))), "path").select("asked", "doc_id")
    alone = by_suffix.join(by_path, "asked", "left_anti").unionByName(by_path).groupBy("asked").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("to")).filter("n = 1").select("asked", "to")
    single = naming(links, documents).groupBy("document", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("to")).filter("n = 1").select("document", "to").distinct()
    found = single.join(F.broadcast(alone), "to").groupBy("document").agg(F.count_distinct("asked").alias("n"))
    return found.filter(F.col("n") == len(set(targets))).select(F.col("document").alias("doc_id"))
