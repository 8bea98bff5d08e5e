"""Near-duplicate records with small edits (problem 6): an exact set-similarity join over word shingles by a token-group matrix.

1. Every text becomes the set of hashes of its runs of `width` words. Texts of equal sets are one class with one representative.
2. Representatives are partitioned into groups of similar sets: same minima of some hashes over the set, same size class.
3. Tokens are ordered by a count sketch over all sets, rarest first (any order gives the same result; this one keeps the matrix thin).
   The token-group matrix holds, for each group, the union of its members' leading tokens: a set of n tokens leads with as many
   as any partner of at least the threshold must share `depth` of (the prefix rule of set joins).
4. A query set's overlap with a group's union bounds its overlap with every member. Only groups that reach `depth` shared leading
   tokens, and hold sizes that the threshold allows, are opened; the members' whole sets are then compared exactly.

No pair at or above the threshold is lost: the rules in 3 and 4 are bounds, not samples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.llm import kernel
from vaultframe.session import materialize, skew_join, slices, spread

#: Counters of the token sketch: 2 ** SKETCH_BITS. Its broadcast is a byte for each, whatever the corpus' size.
SKETCH_BITS = 20
_BLOCK_BITS = 14
#: Members of a group agree in as many minimum hashes: fewer make larger, looser groups, whose unions bound less well.
GROUP_HASHES = 3
#: Copies of a class that meet in one task when all its pairs are listed.
CLASS_ROWS = 2000
#: Slots of the filter over the sets that are compared: 2 ** SLOT_BITS, the most rows that its broadcast can have.
SLOT_BITS = 18
#: Bytes of text, and tokens, that a task handles at once.
CHUNK_BYTES, CHUNK_TOKENS = 1_000_000, 300_000


def shingle_table(df: DataFrame, key: str, text: str, width: int, min_words: int) -> DataFrame:
    """(doc, mark, head, tokens): the distinct shingle hashes of each text of at least `min_words` words, a 128-bit mark of the set and its first 64 bits.
    Null texts and those with fewer words, or with fewer than `width`, give no row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, CHUNK_BYTES):
            sets, counts = kernel.shingle_sets(batch.column(1).to_pylist(), width)
            keep = [i for i in range(len(sets)) if counts[i] >= max(min_words, 1) and len(sets[i])]
            if keep:
                limits = np.concatenate(([0], np.cumsum([len(sets[i]) for i in keep]))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(limits), pa.array(np.concatenate([sets[i] for i in keep]).view(np.int64)))
                marks = [hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in keep]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(marks, pa.binary()), pa.array([int.from_bytes(m[:8], "little", signed=True) for m in marks], pa.int64()), tokens], names=["doc", "mark", "head", "tokens"])

    return spread(df.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("text is not null")).mapInArrow(make, f"doc {dict(df.dtypes)[key]}, mark binary, head bigint, tokens array<bigint>")


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def token_sketch(sets: DataFrame) -> np.ndarray:
    """How often tokens occur over all sets, by slot of their hash, on a logarithmic scale of one byte. Counted and summed on the
    executors in blocks; the driver gets 2 ** SKETCH_BITS bytes, never tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy()
            total += np.bincount(_slots(values), minlength=len(total)).astype(np.uint32)
        blocks = total.reshape(-1, 1 << _BLOCK_BITS)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        scaled = {i: np.minimum(255, 12 * np.log2(s + 1.0)).astype(np.uint8).tobytes() for i, s in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(scaled), pa.int32()), pa.array(list(scaled.values()), pa.binary())], names=["block", "counts"])

    parts = 1 << min(3, SKETCH_BITS - _BLOCK_BITS)
    rows = sets.select("tokens").mapInArrow(count, "block int, counts binary").repartition(parts, "block").mapInArrow(add, "block int, counts binary").collect()
    out = np.zeros((1 << (SKETCH_BITS - _BLOCK_BITS), 1 << _BLOCK_BITS), np.uint8)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def leading_tokens(sets: DataFrame, sketch: np.ndarray, threshold: float, depth: int) -> DataFrame:
    """(id, size, grp, tokens, indexed): the leading tokens of each distinct set, in order; `id` is the head of its mark. The first `indexed`
    suffice when all partners are at least as large. A partition says each set once, so copies don't pile up on their tokens."""
    shared = sets.sparkSession.sparkContext.broadcast(sketch)
    both = 2 * threshold / (1 + threshold)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, said = shared.value, set()
        for batch in slices(batches, 2, CHUNK_TOKENS):
            fresh = [i for i, m in enumerate(batch.column(0).to_pylist()) if m not in said and not said.add(m)]
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh, pa.int64()))
            ids, column = batch.column(1).to_numpy(), batch.column(2)
            limits = column.offsets.to_numpy()
            values = column.values.to_numpy()[limits[0] : limits[-1]]
            limits = limits - limits[0]
            sizes = np.diff(limits)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            tokens = values.view(np.uint64)
            # minima of some independent hashes over each set, and the size class: similar sets meet
            group = np.floor(np.log(sizes) / -np.log(min(threshold, 0.99))).astype(np.uint64)
            for seed in range(1, GROUP_HASHES + 1):
                least = np.minimum.reduceat(kernel.mix(tokens ^ np.uint64(0x5851F42D4C957F2D * seed % 2**64)), limits[:-1])
                group = kernel.mix(group + least)
            group = group.view(np.int64)
            order = np.lexsort((tokens, rank[_slots(values)], owner))
            place = np.arange(len(tokens)) - limits[:-1][owner]
            query = np.minimum(sizes, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + depth)
            index = np.minimum(sizes, sizes - np.ceil(both * sizes - 1e-9).astype(np.int64) + depth)
            keep = place < query[owner]
            ends = np.concatenate(([0], np.cumsum(query))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(sizes.astype(np.int32)), pa.array(group), pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order[keep]])), pa.array(index.astype(np.int32))],
                names=["id", "size", "grp", "tokens", "indexed"],
            )

    return sets.select("mark", "head", "tokens").mapInArrow(lead, "id bigint, size int, grp bigint, tokens array<bigint>, indexed int")


class NearDuplicates:
    """The result of a similarity join: `members` (doc, rep) has every text of enough words with its class representative (the smallest
    key among texts of equal shingle sets); `pairs` (a, b, similarity) has the similar pairs of representatives, a < b."""

    def __init__(self, members: DataFrame, pairs: DataFrame) -> None:
        self.members, self.pairs = members, pairs

    def expanded(self) -> DataFrame:
        """(doc_a, doc_b): all similar pairs of texts, copies included. As many rows as there are pairs, by its nature."""
        m = self.members
        of_a, of_b = m.select(F.col("rep").alias("a"), F.col("doc").alias("x")), m.select(F.col("rep").alias("b"), F.col("doc").alias("y"))
        across = self.pairs.select("a", "b").join(of_a, "a").join(of_b, "b").select("x", "y")
        # a class of more than CLASS_ROWS copies is cut into blocks that meet pairwise, each meeting a task's own
        sizes = m.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / CLASS_ROWS).cast("int").alias("blocks")).filter("blocks > 1")
        placed = skew_join(m.select("rep", "doc"), sizes, "rep", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        left = placed.select("rep", F.col("doc").alias("x"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
        right = placed.select("rep", F.col("doc").alias("y"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))
        within = left.join(right, ["rep", "i", "j"]).filter("i < j or x < y").select("x", "y")
        return across.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def groups(self) -> DataFrame:
        """(doc, rep, grp): every text with its class and its connected group, named by the group's smallest representative."""
        label = components(self.pairs.select("a", "b"))
        return self.members.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select("doc", "rep", F.coalesce("label", "rep").alias("grp"))


def _alike(text: Column, width: int) -> Column:
    """What texts too short for a shingle are classed by: their lower-cased words, or the unchanged text where there is no word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)
    few = F.size(words) < width
    return F.when(few & (F.size(words) > 0), F.concat(F.lit("w"), F.array_join(words, " "))).when(few, F.concat(F.lit("t"), text))


def every_text(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc, rep, grp, links): each row of `df` (unique `key`) with its class of equal texts, its connected group, and with how many other
    rows it is linked: those of its class and of the classes similar to it.

    The join is `near_duplicates` with no least number of words. Texts too short for a shingle are classed by equal words, those without a
    word by the unchanged text. A null text is alone."""
    near = near_duplicates(df, key, text, width, threshold, min_words=1)
    held = near.groups()
    rest = df.select(F.col(key).alias("doc"), F.sha2(F.encode(_alike(F.col(text), width), "utf-8"), 256).alias("alike")).join(held.select("doc"), "doc", "left_anti")
    short = rest.filter("alike is not null")
    short = skew_join(short, short.groupBy("alike").agg(F.min("doc").alias("rep")), "alike", "inner").select("doc", "rep", F.col("rep").alias("grp"))
    alone = rest.filter("alike is null").select("doc", F.col("doc").alias("rep"), F.col("doc").alias("grp"))
    rows = materialize(held.unionByName(short).unionByName(alone), "classed")
    sizes = rows.groupBy("rep").agg(F.count(F.lit(1)).alias("rows"))
    both = near.pairs.select("a", "b").unionByName(near.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("rows").alias("across"))
    links = sizes.join(across, "rep", "left").select("rep", (F.col("rows") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
    return skew_join(rows, links, "rep", "inner").select("doc", "rep", "grp", "links")


def near_duplicates(df: DataFrame, key: str, text: str, width: int = 5, threshold: float = 0.8, min_words: int = 1, depth: int = 4) -> NearDuplicates:
    """Texts whose sets of distinct runs of `width` lower-cased words have an intersection of at least `threshold` of their union.

    Exact. Null texts, and texts of fewer than `min_words` or `width` words, take part in nothing. Repeated rows count
    once; if a key's rows differ in text, each text is compared and the key gets every partner. Columns besides `key` and `text` are ignored. An empty table
    gives empty results. `depth` (at least 1) is how many leading tokens must be shared before a group is opened; it changes cost only."""
    sets = materialize(shingle_table(df, key, text, width, min_words), "shingles")
    marked = sets.select("doc", "mark", "head")
    members = materialize(skew_join(marked, marked.groupBy("mark").agg(F.min("doc").alias("rep")), "mark", "inner").select("doc", "head", "rep").distinct(), "members")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leads = materialize(leading_tokens(sets, token_sketch(sets), threshold, depth), "leads")
    indexed = leads.select(F.explode(F.slice("tokens", 1, F.col("indexed"))).alias("token"), "grp", "size").repartition(parts, "token")
    matrix = indexed.groupBy("token", "grp").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    asked = leads.select(F.explode("tokens").alias("token"), F.col("id").alias("y"), F.col("size").alias("size_y")).repartition(parts, "token").distinct()
    bound = (
        asked.join(matrix, "token")
        .filter((F.col("most") >= F.lit(threshold - 1e-9) * F.col("size_y")) & (F.col("least") <= F.col("size_y")))
        .groupBy("y", "size_y", "grp")
        .agg(F.count(F.lit(1)).alias("shared"))
        .filter(F.col("shared") >= F.least(F.lit(depth), F.ceil(F.lit(threshold) * F.col("size_y") - 1e-9)))
    )
    group_of = leads.groupBy("grp", F.col("id").alias("x")).agg(F.first("size").alias("size_x"))
    opened = bound.join(group_of, "grp").filter(
        ((F.col("size_x") < F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("x") < F.col("y")))) & (F.col("size_x") >= F.lit(threshold - 1e-9) * F.col("size_y"))
    )
    # from ids to the representatives' keys; two sets whose marks share a head are both compared
    named = members.filter("doc = rep").select("doc", F.col("head").alias("id"))
    opened = opened.select("x", "y").join(named.select(F.col("id").alias("x"), F.col("doc").alias("dx")), "x").join(named.select(F.col("id").alias("y"), F.col("doc").alias("dy")), "y")
    opened = materialize(opened.select(F.col("dx").alias("x"), F.col("dy").alias("y")), "opened")
    compared = _asked_for(sets, opened)
    with_x = opened.join(compared.select(F.col("doc").alias("x"), F.col("tokens").alias("tx")), "x")
    with_both = with_x.join(compared.select(F.col("doc").alias("y"), F.col("tokens").alias("ty")), "y")
    both = F.size(F.array_intersect("tx", "ty"))
    pairs = (
        with_both.select("x", "y", both.alias("both"), (F.size("tx") + F.size("ty")).alias("sizes"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("both").cast("double") / (F.col("sizes") - F.col("both"))).alias("similarity"))
        .filter((F.col("similarity") >= threshold) & (F.col("a") < F.col("b")))
        .distinct()
    )
    return NearDuplicates(members, materialize(pairs, "similar"))


def _asked_for(sets: DataFrame, opened: DataFrame) -> DataFrame:
    """(doc, tokens) of the sets that a pair of `opened` (x, y) needs, and a few more: a document passes if the slot of its hash, one of 2 **
    SLOT_BITS, is some needed document's. The slots are broadcast, so sets that nobody asks for aren't shuffled."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SLOT_BITS)).alias("slot")
    needed = materialize(opened.select(slot("x")).union(opened.select(slot("y"))).distinct(), "slots")
    return sets.select("doc", "tokens", slot("doc")).join(F.broadcast(needed), "slot", "left_semi").select("doc", "tokens")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): connected components of (a, b), each named by its smallest node. Hook to the least neighbour and shortcut, until
    nothing changes: rounds grow with the logarithm of the longest path, each is cut from the last by a written table."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("up"))
        step = materialize(hooked.join(up, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("up", "next")).alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels
