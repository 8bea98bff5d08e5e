"""Queries of the subpackage's problems over the vault's tables, each with SQL where SQL can express it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultframe.llm import chunks, cooccurrence, encoding, neardup, neighbours, packing, reading
from vaultframe.llm.sql import ORACLES as ORACLES
from vaultframe.session import materialize, table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, sf, "document_vectors"), k=5, least=0.9)


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 nearest of each document whose id is divisible by 50, among all."""
    return neighbours.nearest_documents(table(spark, sf, "document_vectors"), k=5, every=50).withColumn("cosine", F.round("cosine", 9))


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_tags").select("document", F.lower("name").alias("tag"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = cooccurrence.associations(_tags(spark, sf), "document", "tag", min_count=5, min_lift=4)
    return found.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def _associations(spark: SparkSession, sf: str, min_count: int) -> DataFrame:
    found = cooccurrence.associations(_tags(spark, sf), "document", "tag", min_count=min_count)
    return found.withColumnsRenamed({"item_a": "tag_a", "item_b": "tag_b"})


def p3_surprise(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of tags that share a document, those that share only one included."""
    return _associations(spark, sf, min_count=1)


def p3_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The counts and ratios of p3_surprise, which SQL has too."""
    return p3_surprise(spark, sf).select("tag_a", "tag_b", "together", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Of pairs that share two documents or more, as the SQL has it; p3_surprise has all."""
    return _associations(spark, sf, min_count=2).select("tag_a", "tag_b", "together", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.oversized_blocks(table(spark, sf, "documents"), "doc_id", "body", table(spark, sf, "headings"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.split(table(spark, sf, "documents"), "doc_id", "body", table(spark, sf, "headings"))


def p4_covered(spark: SparkSession, sf: str) -> DataFrame:
    """What the pieces of each long body keep to: bytes covered, the limit, the order, the overlap, and the body's own bytes."""
    long = table(spark, sf, "documents").select("doc_id", F.col("body").cast("binary").alias("body")).filter(F.octet_length("body") > chunks.LIMIT)
    each = p4_pieces(spark, sf).join(long, "doc_id")
    before = Window.partitionBy("doc_id").orderBy("piece")
    repeated = F.col("new_from") - F.col("start")
    own = F.expr("substring(body, cast(start + 1 as int), cast(stop - start as int))") == F.encode("text", "utf-8")
    joined = F.col("new_from") == F.coalesce(F.lag("stop").over(before), F.lit(0))
    laps = F.when(F.col("piece") == 0, repeated == 0).otherwise(repeated.between(chunks.OVERLAP, chunks.OVERLAP + 3) | (F.col("start") == 0))
    judged = each.select("doc_id", (F.col("stop") - F.col("new_from")).alias("new"), (F.col("stop") - F.col("start") <= chunks.LIMIT).alias("short"), joined.alias("joined"), laps.alias("laps"), own.alias("own"))
    return judged.groupBy("doc_id").agg(F.sum("new").alias("bytes"), F.every("short").alias("short"), F.every("joined").alias("joined"), F.every("laps").alias("laps"), F.every("own").alias("own"))


def _near(spark: SparkSession, sf: str) -> neardup.NearDuplicates:
    return neardup.near_duplicates(table(spark, sf, "documents"), "doc_id", "body", width=3, threshold=0.7, min_words=50)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).expanded()


_CLASSED = {"doc": "doc_id", "rep": "class_id", "grp": "group_id"}


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, however short, by the measure of p6_found: class, group and number of linked documents."""
    return neardup.every_text(table(spark, sf, "documents"), "doc_id", "body", width=3, threshold=0.7).withColumnsRenamed(_CLASSED)


def p6_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Of bodies of 50 words or more, as the SQL has it; p6_documents has all."""
    return _near(spark, sf).groups().withColumnsRenamed(_CLASSED)


def p6_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The subpackage's usual measure: five words, 0.8; representatives' pairs."""
    return neardup.near_duplicates(table(spark, sf, "documents"), "doc_id", "body").pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.round("similarity", 6).alias("similarity"))


def p6_strict_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document by the measure of p6_strict, the copies that p6_strict leaves out included."""
    return neardup.every_text(table(spark, sf, "documents"), "doc_id", "body").withColumnsRenamed(_CLASSED)


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode(table(spark, sf, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.decode(p7_ids(spark, sf), "doc_id", "ids")


def _packed(spark: SparkSession, sf: str, **limits) -> DataFrame:
    sizes = packing.token_sizes(table(spark, sf, "documents"), "doc_id", "text", F.col("body_offset"))
    return packing.pack(sizes, "doc_id", **limits)


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p8_instruction(spark: SparkSession, sf: str) -> DataFrame:
    """With limits that bind: at most 6 segments and 1,900 tokens of body a container."""
    return _packed(spark, sf, max_segments=6, max_loss=1900)


def p8_limits(spark: SparkSession, sf: str) -> DataFrame:
    """What p8_instruction keeps to: (broken, cases) for each rule, and how many documents there are."""
    items = materialize(packing.token_sizes(table(spark, sf, "documents"), "doc_id", "text", F.col("body_offset")), "sizes")
    packed = materialize(packing.pack(items, "doc_id", max_segments=6, max_loss=1900), "packed")
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.sum((F.col("tokens") > 0).cast("int")).alias("s"), F.sum("loss").alias("l"), F.max(F.col("start") + F.col("tokens")).alias("e"))
    docs = packed.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.sum("loss").alias("l"), F.count(F.lit(1)).alias("parts")).join(items, "doc_id", "full_outer")
    count = lambda df, rules: df.agg(*[F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(n) for n, c in rules.items()]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("broken"), F.col(n).alias("cases")) for n in rules])).alias("r")).select("r.*")
    of_boxes = count(boxes, {"tokens": F.col("t") > packing.CAPACITY, "segments": F.col("s") > 6, "loss": F.col("l") > 1900, "overlapping": F.col("e") != F.col("t")})
    return of_boxes.unionByName(count(docs, {"lost": ~F.col("t").eqNullSafe(F.col("tokens")) | (docs["l"] != docs["loss"]), "cut": (F.col("parts") > 1) & (F.col("tokens") <= packing.CAPACITY) & (docs["loss"] <= 1900)})).unionByName(
        docs.agg(F.lit("documents").alias("broken"), F.count(F.lit(1)).alias("cases"))
    )


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf))


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_level(table(spark, sf, "documents"), "doc_id", "body", table(spark, sf, "reading_labels"), "doc_id", "grade")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    demanding = (F.col("words") >= 80) & (F.col("letters") > 5.8 * F.col("words")) & (F.col("words") > 18 * F.col("sentences"))
    return p9_levels(spark, sf).filter(demanding & F.col("difficulty").isNotNull()).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_neighbours, p3_found, p3_surprise, p3_pairs, p3_counts, p4_found, p4_pieces, p4_covered, p6_found, p6_documents, p6_groups, p6_strict, p6_strict_documents, p7_ids, p7_decoded,
        p8_containers, p8_instruction, p8_limits, p8_report, p9_found, p9_levels,
    )
}
