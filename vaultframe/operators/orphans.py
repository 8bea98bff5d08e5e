"""References to records that do not exist (problem 5).

`missing_keys` is the operator: parents and probes are range-partitioned by their key's hash; a range's parents become one sorted array,
and batches of probes are looked up in it by binary search. Both sides are distinct before they move, so that a key held by a
third of all references travels once. `orphan_links` states the vault's rules with it: every link becomes the keys its target
and anchor may match, and a reference is an orphan if none of its keys has a parent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.operators import paths
from vaultframe.session import materialize, skew_join


#: Distinct keys of both sides that a range is made for, by default.
RANGE_KEYS = 2_000_000


def missing_keys(parents: DataFrame, probes: DataFrame, key: str = "key", ranges: int | None = None) -> DataFrame:
    """The distinct non-null probes that are no parent, as (key). Compares bytes.

    Keys of both sides are range-partitioned by a 64-bit hash of the key, drawn evenly however alike the keys are, and a range's parents are held
    as the sorted array of their hashes, in which a batch of probes is found by one vectorised binary search; only where hashes meet are the
    bytes compared. Null keys take no part. Empty sides are fine: without parents all probes are missing. Repeated keys count once;
    other columns are ignored. `ranges`: by default as many as give each RANGE_KEYS rows, and no fewer than spark.sql.shuffle.partitions."""
    spark = parents.sparkSession
    own = parents.select(F.col(key).alias("key")).filter("key is not null").distinct().withColumn("probe", F.lit(False))
    asked = probes.select(F.col(key).alias("key")).filter("key is not null").distinct().withColumn("probe", F.lit(True))
    both = own.unionByName(asked).withColumn("h", F.xxhash64("key"))
    n = ranges
    if n is None:
        both = materialize(both, "keys")  # also what the ranges' bounds are drawn from, so that the sides aren't derived twice
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // RANGE_KEYS))
    ranged = both.repartitionByRange(n, "h").sortWithinPartitions("probe", "h")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        names: list[pa.Array] = []
        for batch in batches:
            keys, probe, h = batch.column(0).cast(pa.large_binary()), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            first = int(np.searchsorted(probe, True))  # parents come first
            if first:
                hashes.append(h[:first].copy())
                names.append(keys.slice(0, first))
            if first < len(h):
                if len(hashes) != 1:
                    hashes = [np.concatenate(hashes) if hashes else np.zeros(0, np.int64)]
                    names = [pa.concat_arrays(names) if names else pa.array([], pa.large_binary())]
                parent, asks, asked = hashes[0], keys.slice(first), h[first:]
                low, high = np.searchsorted(parent, asked, "left"), np.searchsorted(parent, asked, "right")
                found = np.zeros(len(asked), bool)
                step = 0
                while True:  # one round, but for hashes that several parents share
                    open_ = np.flatnonzero(~found & (low + step < high))
                    if not len(open_):
                        break
                    same = pc.equal(names[0].take(pa.array(low[open_] + step)), asks.take(pa.array(open_)))
                    found[open_] = same.to_numpy(zero_copy_only=False)
                    step += 1
                yield pa.RecordBatch.from_arrays([asks.filter(pa.array(~found)).cast(pa.large_string()).cast(pa.string())], names=["key"])

    return ranged.mapInArrow(search, "key string")


def _key(kind: str, *parts: Column) -> Column:
    """Parts joined so that no two different lists of them give the same text: each is led by its length."""
    return F.concat(F.lit(kind), *(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)))


def link_keys(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Each link without a protocol with the keys it may match: `target_keys`, and `anchor_keys` where it has an anchor.

    A null target is taken to name nothing. Only relative Markdown targets need their document's path: those rows alone are joined."""
    live = links.filter(F.col("protocol").isNull())
    target = F.col("target")
    own, markdown = F.coalesce(target == "", F.lit(False)), F.col("family") == "markdown"
    needs = markdown & ~own & target.isNotNull() & ~target.startswith("/")
    home = documents.select(F.col("doc_id").alias("document"), F.col("path").alias("home"))
    picked = live.select("document", "ordinal", "family", "target", "anchor")
    near = skew_join(picked.filter(needs), home, "document", "left")
    far = picked.filter(~F.coalesce(needs, F.lit(False))).withColumn("home", F.lit(None).cast("string"))
    named = (
        F.when(own, F.array(_key("d", F.coalesce(F.col("document").cast("string"), F.lit("")))))
        .when(markdown, F.array(_key("m", paths.relative(F.coalesce("home", F.lit("")), target))))
        .otherwise(F.transform(paths.suffix_forms(target), lambda t: _key("w", t)))
    )
    how = F.when(markdown, F.lit("s")).otherwise(F.lit("t"))
    return (
        near.unionByName(far)
        .withColumn("target_keys", F.filter(named, lambda k: k.isNotNull()))
        .withColumn("anchor_keys", F.when(F.col("anchor").isNotNull(), F.transform("target_keys", lambda k: F.concat(k, how, F.col("anchor")))))
    )


def document_keys(documents: DataFrame) -> DataFrame:
    """(doc_id, keys): the target keys that name each document."""
    return documents.select(
        "doc_id",
        F.concat(
            F.array(_key("d", F.col("doc_id").cast("string")), _key("m", F.col("path"))),
            F.transform(paths.suffixes(F.col("path")), lambda s: _key("w", s)),
        ).alias("keys"),
    )


def parent_keys(documents: DataFrame, headings: DataFrame) -> DataFrame:
    """(key): everything a target key or an anchor key can match. As many for a document as its path is deep, for it and for each heading."""
    named = document_keys(documents)
    places = headings.select(F.col("document").alias("doc_id"), "text", "slug").distinct()
    # a Markdown target takes slugs, a wikilink texts, a document's own link either
    anchored = places.join(named, "doc_id").select(
        F.explode(
            F.concat(
                F.transform(F.filter("keys", lambda k: ~k.startswith("m")), lambda k: F.concat(k, F.lit("t"), F.col("text"))),
                F.transform(F.filter("keys", lambda k: ~k.startswith("w")), lambda k: F.concat(k, F.lit("s"), F.col("slug"))),
            )
        ).alias("key")
    )
    return named.select(F.explode("keys").alias("key")).unionByName(anchored)


def orphan_links(links: DataFrame, documents: DataFrame, headings: DataFrame) -> DataFrame:
    """(document, ordinal, missing_in): links without a protocol whose target names no document ('documents'), or whose non-null anchor
    none of the named documents has ('headings'). Repeated links count once. Documents and headings that came later than the link
    count; percent signs mean themselves; block references aren't judged. Empty tables, null columns and very long targets are
    fine: a link with a null target names nothing. Columns besides those of the vault's tables are ignored."""
    keyed = materialize(link_keys(links, documents).select("document", "ordinal", "target_keys", "anchor_keys"), "link-keys")
    keys = ("target_keys", "anchor_keys")
    refs = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("links"))  # hot targets become one row here
    probes = refs.select(F.explode(F.concat("target_keys", F.coalesce("anchor_keys", F.array().cast("array<string>")))).alias("key"))
    missing = materialize(missing_keys(parent_keys(documents, headings), probes), "missing")
    # each reference's keys that are missing, by kind; a target's key stands in as many references as it has anchors, hence the skew-safe join
    asked = refs.select(
        *keys, F.explode(F.concat(F.transform("target_keys", lambda k: F.struct(k.alias("key"), F.lit(True).alias("of_target"))), F.transform(F.coalesce("anchor_keys", F.array().cast("array<string>")), lambda k: F.struct(k.alias("key"), F.lit(False).alias("of_target"))))).alias("k")
    ).select(*keys, "k.key", "k.of_target")
    lost = skew_join(asked, missing, "key", "inner").groupBy(*keys).agg(F.sum(F.col("of_target").cast("int")).alias("t"), F.sum((~F.col("of_target")).cast("int")).alias("a"))
    verdict = materialize(lost.select(
        _ref(),
        F.when(F.col("t") == F.size("target_keys"), "documents").when(F.col("anchor_keys").isNotNull() & (F.col("a") == F.size("anchor_keys")), "headings").alias("missing_in"),
    ).filter("missing_in is not null"), "verdicts")
    rows = keyed.select("document", "ordinal", _ref(), (F.size("target_keys") == 0).alias("nameless"))
    found = skew_join(rows.filter(~F.col("nameless")), verdict, "ref", "inner").select("document", "ordinal", "missing_in")
    nameless = rows.filter("nameless").select("document", "ordinal", F.lit("documents").alias("missing_in"))
    return found.unionByName(nameless).distinct()


def _ref() -> Column:
    """What a link asks for, as one key: its target's keys, and its anchor's where it has one."""
    return F.concat_ws("\u0000", F.array_join("target_keys", "\u0000"), F.array_join("anchor_keys", "\u0000")).alias("ref")


def orphan_report(orphans: DataFrame, documents: DataFrame) -> DataFrame:
    """(missing_in, month, orphans): counts by missing table and by the UTC month of the link's document's derived_at.
    Links of documents that have no row, or no time, stand under the month null."""
    when = documents.select(F.col("doc_id").alias("document"), F.date_format(F.timestamp_seconds("derived_at"), "yyyy-MM").alias("month"))
    return skew_join(orphans, when, "document", "left").groupBy("missing_in", "month").agg(F.count(F.lit(1)).alias("orphans"))
