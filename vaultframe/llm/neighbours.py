"""Most similar vectors for every vector (problem 2): multi-index hashing over learned rotated binary codes.

1. For each space (model and dimensions) some rotations are learned on a bounded sample by iterative quantisation: each turns the leading
   directions of the sample so that the signs of a vector's coordinates lose as little of it as possible.
2. A vector's code is the signs under all rotations, cut into TABLES substrings of BITS bits, each an index of its own.
3. Vectors meet in a table if their substrings differ in at most one bit. By the pigeonhole principle every pair of codes within
   2 * TABLES - 1 bits meets somewhere; of pairs beyond that, most do. One bit is probed inside a partition, by binary search in its
   sorted substrings, so a vector is one row for each table, not one for each probe.
4. Pairs whose codes are further apart than RADIUS of the first CHECK bits are dropped, the rest are reranked by their float cosine.

Only the rotations are fitted on a sample; every vector is coded, indexed and probed. `nearest_documents` has no least cosine and uses no
codes: it compares its queries with all vectors, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.session import materialize, skew_join, spread

TABLES, BITS = 20, 16
CHECK_WORDS = 4
#: Of 64 * CHECK_WORDS bits. A cosine of 0.9 makes 14 % of all signs differ on average, 37 of 256; this is over four deviations more.
RADIUS = 60
#: Vectors of each space that its rotations are learned on.
SAMPLE = 4096
#: A table of a space is cut by leading bits of the substring until a part holds about this many vectors.
PART_ROWS = 250_000


def learn_rotations(sample: np.ndarray, seed: int, rounds: int = 20) -> np.ndarray:
    """A (dimensions, TABLES * BITS) matrix whose signs are the code: rotations of the sample's leading directions, each refined by
    iterative quantisation from a different random start."""
    rng = np.random.default_rng(seed)
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)
    values, vectors = np.linalg.eigh(x.T @ x)
    order = np.argsort(values)[::-1]
    # directions of little variance flip first between neighbours, but using only few makes all tables alike
    keep = vectors[:, order[: max(1, min(x.shape[1], max(BITS, int(x.shape[1] * 0.75))))]]
    width = keep.shape[1]
    y = x @ keep
    columns: list[np.ndarray] = []
    total = 0
    while total < TABLES * BITS:
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds if len(x) > width else 0):
            u, _, vt = np.linalg.svd(y.T @ np.sign(y @ r), full_matrices=False)
            r = u @ vt
        columns.append(keep @ r)
        total += width
    return np.concatenate(columns, axis=1)[:, : TABLES * BITS].astype(np.float32)


def usable(df: DataFrame) -> DataFrame:
    """(document, model_id, dimensions, embedding) of the rows that take part: an embedding that is there, of the stated size, without null, NaN
    or infinity, and not all zero."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    right = F.col("document").isNotNull() & F.col("model_id").isNotNull() & (F.size("embedding") == F.col("dimensions")) & (F.col("dimensions") > 0)
    return df.select("document", "model_id", "dimensions", F.col("embedding").cast("array<float>").alias("embedding")).filter(right).filter(good)


#: Queries that one broadcast holds, in bytes, and the rows of either side of one block of products.
ROUND_BYTES, BLOCK_ROWS = 8_000_000, 2048


def keep_best(cosines: np.ndarray, others: np.ndarray, found: np.ndarray, docs: np.ndarray) -> None:
    """Puts `found` (a row for each query, a column for each of the ascending `docs`) among each query's best so far, in place: `cosines`
    (rounded to 12 places, -inf where there is none yet) descending, `others` ascending among ties, no document twice."""
    k = cosines.shape[1]
    starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    if len(starts) < len(docs):
        found, docs = np.maximum.reduceat(found, starts, axis=1), docs[starts]
    floor = cosines[:, -1]
    if np.isneginf(floor).any() and found.shape[1] > k:
        floor = np.maximum(floor, np.partition(found, found.shape[1] - k, axis=1)[:, -k])
    i, j = np.nonzero(found >= floor[:, None] - 2e-12)
    if not len(i):
        return
    touched, at = np.unique(i, return_inverse=True)
    old_at, old_k = np.nonzero(cosines[touched] > -np.inf)
    row = np.concatenate((old_at, at))
    other = np.concatenate((others[touched][old_at, old_k], docs[j]))
    cosine = np.concatenate((cosines[touched][old_at, old_k], np.round(found[i, j], 12)))
    order = np.lexsort((-cosine, other, row))
    row, other, cosine = row[order], other[order], cosine[order]
    once = np.concatenate(([True], (row[1:] != row[:-1]) | (other[1:] != other[:-1])))
    row, other, cosine = row[once], other[once], cosine[once]
    order = np.lexsort((other, -cosine, row))
    row, other, cosine = row[order], other[order], cosine[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    good = place < k
    cosines[touched[row[good]], place[good]] = cosine[good]
    others[touched[row[good]], place[good]] = other[good]


class VectorIndex:
    """Distinct usable vectors (`vectors`: vid, model_id, dimensions, embedding), who has them (`owners`: vid, document) and the learned rotations."""

    def __init__(self, df: DataFrame) -> None:
        rows = usable(df).withColumn("h", F.xxhash64("embedding")).withColumn("g", F.xxhash64(F.lit(1), "embedding", "dimensions"))
        same = ["model_id", "dimensions", "h", "g"]
        distinct = rows.groupBy(*same).agg(F.first("embedding").alias("embedding"))
        # numbered as they are written, once: whoever reads the files sees the same numbers
        self.vectors = materialize(distinct.select(F.monotonically_increasing_id().alias("vid"), *same, "embedding"), "vectors")
        self.owners = materialize(rows.select(*same, "document").distinct().join(self.vectors.select(*same, "vid"), same).select("vid", "document"), "owners")
        self.sizes = {(r["model_id"], r["dimensions"]): r["count"] for r in self.vectors.groupBy("model_id", "dimensions").count().collect()}
        self.spaces = {s: i for i, s in enumerate(sorted(self.sizes))}

    @cached_property
    def rotations(self) -> dict[tuple, np.ndarray]:
        """One bounded sample for each space, by the order of the vectors' hashes; fitted on the driver. Spaces are as many as embedding models."""
        first = Window.partitionBy("model_id", "dimensions").orderBy("h", "g")
        share = F.lit(None).cast("double")
        for (m, d), n in self.sizes.items():
            share = F.when((F.col("model_id") == m) & (F.col("dimensions") == d), F.lit(min(1.0, 2 * SAMPLE / n))).otherwise(share)
        near = self.vectors.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share * (1 << 30))
        rows = near.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE).select("model_id", "dimensions", "embedding").collect()
        sample: dict[tuple, list] = {s: [] for s in self.spaces}
        for r in rows:
            sample[(r[0], r[1])].append(r[2])
        return {s: learn_rotations(np.array(x, np.float64).reshape(-1, s[1]) if x else np.eye(s[1]), self.spaces[s]) for s, x in sample.items()}

    def codes(self) -> DataFrame:
        """(part, probe, sub, vid, c0 ..): a row for each vector and table, by table part; where a table is cut, a second kind of row
        probes the parts that differ in one of the leading bits."""
        shared = self.vectors.sparkSession.sparkContext.broadcast((self.spaces, self.rotations, {s: max(0, int(np.ceil(np.log2(n / PART_ROWS)))) for s, n in self.sizes.items()}))

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spaces, rotations, cut = shared.value
            for batch in batches:
                names = np.array([spaces[s] for s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())])
                vids, column = batch.column(0).to_numpy(), batch.column(3)
                for space, number in spaces.items():
                    at = np.flatnonzero(names == number)
                    if not len(at):
                        continue
                    x = column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), space[1])
                    bits = (x @ rotations[space]) > 0
                    subs = np.packbits(bits, axis=1).view(">u2").astype(np.int32)
                    check = np.ascontiguousarray(np.packbits(bits[:, : 64 * CHECK_WORDS], axis=1)).view(np.int64)
                    lead = cut[space]
                    prefix, rest = subs >> (BITS - lead), subs & ((1 << (BITS - lead)) - 1)
                    part = ((number * TABLES + np.arange(TABLES)) << BITS)[None, :]
                    for flip in [0, *(1 << j for j in range(lead))]:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array((part + (prefix ^ flip)).ravel().astype(np.int32)),
                                pa.array(np.full(subs.size, flip > 0)),
                                pa.array(rest.ravel().astype(np.int32)),
                                pa.array(np.repeat(vids[at], TABLES)),
                                *(pa.array(np.repeat(check[:, w], TABLES)) for w in range(CHECK_WORDS)),
                            ],
                            names=["part", "probe", "sub", "vid", *(f"c{w}" for w in range(CHECK_WORDS))],
                        )

        return self.vectors.select("vid", "model_id", "dimensions", "embedding").mapInArrow(code, "part int, probe boolean, sub int, vid bigint, " + ", ".join(f"c{w} bigint" for w in range(CHECK_WORDS)))

    def candidates(self, radius: int = RADIUS) -> DataFrame:
        """(x, y): distinct pairs of vectors that meet in some table within one bit and whose check bits differ in at most `radius`."""
        spark = self.vectors.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = self.codes().repartition(parts, "part").sortWithinPartitions("part", "probe", "sub")

        def near(sub: np.ndarray, vid: np.ndarray, code: np.ndarray, query: np.ndarray, qvid: np.ndarray, qcode: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for mask in [0, *(1 << j for j in range(BITS))] if own else [0]:
                asks = np.arange(len(query)) if mask == 0 else np.flatnonzero((query & mask) == 0)
                low = np.searchsorted(sub, query[asks] | mask, "left")
                high = np.searchsorted(sub, query[asks] | mask, "right")
                if own and mask == 0:
                    low = np.maximum(low, asks + 1)  # each pair of one bucket once
                count = np.maximum(high - low, 0)
                ends = np.cumsum(count)
                start = 0
                while start < len(asks):  # some million comparisons at a time, however full a bucket is
                    stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 4_000_000, "right")))
                    n = count[start:stop]
                    i = np.repeat(asks[start:stop], n)
                    j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[start:stop], n)
                    apart = np.zeros(len(i), np.int64)
                    for w in range(CHECK_WORDS):
                        apart += np.bitwise_count(qcode[w][i] ^ code[w][j])
                    hit = apart <= radius
                    if hit.any():
                        yield qvid[i[hit]], vid[j[hit]]
                    start = stop

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held, index = None, [], None

            def build() -> tuple:
                cols = [np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(2 + CHECK_WORDS)]
                return cols[0], cols[1], [c.view(np.uint64) for c in cols[2:]]

            def flush() -> Iterator[pa.RecordBatch]:
                sub, vid, code = build()
                for a, b in near(sub, vid, code, sub, vid, code, True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["x", "y"])

            for batch in batches:
                of, role = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
                cols = [batch.column(k).to_numpy() for k in range(2, 4 + CHECK_WORDS)]
                limits = np.flatnonzero((np.diff(of) != 0) | (np.diff(role.astype(np.int8)) != 0)) + 1
                for a, b in zip([0, *limits], [*limits, len(of)]):
                    if of[a] != part:
                        if part is not None and index is None:
                            yield from flush()
                        part, held, index = of[a], [], None
                    if not role[a]:
                        held.append([c[a:b].copy() for c in cols])
                        continue
                    if index is None:
                        yield from flush()
                        index = build()
                    sub, vid, code = index
                    asks = [c[a:b] for c in cols]
                    for x, y in near(sub, vid, code, asks[0], asks[1], [c.view(np.uint64) for c in asks[2:]], False):
                        once = x < y  # its neighbour probes back
                        yield pa.RecordBatch.from_arrays([pa.array(x[once]), pa.array(y[once])], names=["x", "y"])
            if part is not None and index is None:
                yield from flush()

        return rows.mapInArrow(probe, "x bigint, y bigint").distinct()

    def nearest(self, askers: DataFrame, k: int) -> DataFrame:
        """(model_id, dimensions, x, near): for each vector that `askers` (vid) name, the k distinct documents of greatest cosine among all of its
        space, ties by the smaller document, as (other, cosine). Exact: every vector is compared with every query by float64 products, block by
        block. Queries go out in rounds of ROUND_BYTES, so that a broadcast doesn't grow; vectors aren't shuffled."""
        spark = self.vectors.sparkSession
        heads = self.owners.withColumn("n", F.row_number().over(Window.partitionBy("vid").orderBy("document"))).filter(F.col("n") <= k)
        held = materialize(heads.select("vid", F.col("document").cast("bigint").alias("other")).join(self.vectors, "vid").select("model_id", "dimensions", "other", "embedding"), "held")
        queries = materialize(self.vectors.join(askers.select("vid").distinct(), "vid", "left_semi").select("vid", "model_id", "dimensions", "embedding"), "queries")
        rounds = max(1, -(-4 * (queries.agg(F.sum("dimensions")).first()[0] or 0) // ROUND_BYTES))
        parts = [self._round(held, queries.filter(F.pmod(F.xxhash64("vid"), F.lit(rounds)) == r).toArrow(), k) for r in range(rounds)]
        best = reduce(DataFrame.unionByName, parts).groupBy("x", "other").agg(F.max("cosine").alias("cosine"))
        first = best.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("cosine"), "other"))).filter(F.col("n") <= k)
        lists = first.groupBy("x").agg(F.collect_list(F.struct("other", "cosine")).alias("near"))
        return lists.join(queries.select(F.col("vid").alias("x"), "model_id", "dimensions"), "x")

    def _round(self, held: DataFrame, asked: pa.Table, k: int) -> DataFrame:
        """(x, other, cosine): of each partition of `held`, each query's k best documents."""
        names, vids = list(zip(asked["model_id"].to_pylist(), asked["dimensions"].to_pylist())), asked["vid"].to_numpy()
        sought = {}
        for space in set(names):
            at = np.flatnonzero([n == space for n in names])
            sought[space] = vids[at], asked["embedding"].combine_chunks().take(pa.array(at)).flatten().to_numpy().reshape(len(at), space[1])
        shared = held.sparkSession.sparkContext.broadcast(sought)

        def unit(x: np.ndarray) -> np.ndarray:
            x = x.astype(np.float64)
            return x / np.linalg.norm(x, axis=1, keepdims=True)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spaces = {s: (v, unit(q), np.full((len(v), k), -np.inf), np.zeros((len(v), k), np.int64)) for s, (v, q) in shared.value.items()}
            for batch in batches:
                named = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                docs = batch.column(2).to_numpy()
                for space, (_, q, cosines, others) in spaces.items():
                    at = np.flatnonzero([n == space for n in named])
                    at = at[np.argsort(docs[at], kind="stable")]
                    for low in range(0, len(at), BLOCK_ROWS):
                        rows = at[low : low + BLOCK_ROWS]
                        x = unit(batch.column(3).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), space[1]))
                        for b in range(0, len(q), BLOCK_ROWS):
                            keep_best(cosines[b : b + BLOCK_ROWS], others[b : b + BLOCK_ROWS], q[b : b + BLOCK_ROWS] @ x.T, docs[rows])
            for v, _, cosines, others in spaces.values():
                there = cosines > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(v[:, None], there.shape)[there]), pa.array(others[there]), pa.array(cosines[there])], names=["x", "other", "cosine"])

        return spread(held).mapInArrow(scan, "x bigint, other bigint, cosine double")

    def rerank(self, near: DataFrame) -> DataFrame:
        """(x, y, cosine) of pairs (x, y): the float cosine."""
        v = self.vectors.select("vid", "embedding")
        both = near.join(v.withColumnsRenamed({"vid": "x", "embedding": "ex"}), "x").join(v.withColumnsRenamed({"vid": "y", "embedding": "ey"}), "y")

        def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = batch.column(2), batch.column(3)
                limits = a.offsets.to_numpy() - a.offsets.to_numpy()[0]
                u, w = a.flatten().to_numpy().astype(np.float64), b.flatten().to_numpy().astype(np.float64)
                if not len(u):
                    continue
                dot, uu, ww = (np.add.reduceat(z, limits[:-1]) for z in (u * w, u * u, w * w))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dot / np.sqrt(uu * ww))], names=["x", "y", "cosine"])

        return both.select("x", "y", "ex", "ey").mapInArrow(cosine, "x bigint, y bigint, cosine double")

    def similar(self, least: float, radius: int = RADIUS) -> DataFrame:
        """(x, y, cosine): candidate pairs of vectors whose float cosine is at least `least`."""
        return self.rerank(materialize(self.candidates(radius), "near")).filter(F.col("cosine") >= least)

    def ranked(self, directed: DataFrame, askers: DataFrame, k: int) -> DataFrame:
        """(model_id, dimensions, document, other, cosine, n): the k nearest documents of each document of `askers` (vid, document), from
        vector pairs (x, y, cosine) and from shared vectors. Only a vector's k + 1 smallest owners can be among the k nearest."""
        heads = self.owners.withColumn("n", F.row_number().over(Window.partitionBy("vid").orderBy("document"))).filter(F.col("n") <= k + 1).select("vid", F.col("document").alias("other"))
        own = askers.select(F.col("vid").alias("x"), "document")
        across = directed.join(own, "x").join(heads.withColumnRenamed("vid", "y"), "y").select("x", "document", "other", "cosine")
        within = own.join(heads.withColumnRenamed("vid", "x"), "x").select("x", "document", "other", F.lit(1.0).alias("cosine"))
        space = self.vectors.select(F.col("vid").alias("x"), "model_id", "dimensions")
        near = across.unionByName(within).filter("document <> other").join(space, "x").groupBy("model_id", "dimensions", "document", "other").agg(F.round(F.max("cosine"), 12).alias("cosine"))
        order = Window.partitionBy("model_id", "dimensions", "document").orderBy(F.desc("cosine"), "other")
        return near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)


def neighbour_pairs(df: DataFrame, k: int = 5, least: float = 0.9, radius: int = RADIUS) -> DataFrame:
    """(model_id, dimensions, doc_a, doc_b), doc_a < doc_b: pairs of documents whose vectors' cosine is at least `least` where one is among the k most
    similar of the other, ties by the smaller document.

    df has document, model_id, dimensions and embedding; only vectors of equal model_id and dimensions are compared. Rows whose embedding
    is null, empty, of another size than `dimensions`, all zero or not finite take no part; repeated rows count once; a document with
    several vectors in a space is as near as the nearest of them. Documents that share a vector are kept as its owners, and only the
    k + 1 smallest are anyone's neighbours by it, so copies make rows in proportion, not pairs. Empty tables give an empty result."""
    index = VectorIndex(df)
    similar = materialize(index.similar(least, radius), "similar")
    directed = similar.unionByName(similar.select(F.col("y").alias("x"), F.col("x").alias("y"), "cosine"))
    ranked = index.ranked(directed, index.owners, k)
    return ranked.select("model_id", "dimensions", F.least("document", "other").alias("doc_a"), F.greatest("document", "other").alias("doc_b")).distinct()


def nearest_documents(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(model_id, dimensions, document, rank, other, cosine): the k most similar documents of each document whose id is divisible by `every`,
    searched among all vectors of its space, ties by the smaller document.

    Rows take part as in `neighbour_pairs`. Exact, whatever the vectors are like: neighbours are often far apart here and crowds have equal
    codes, so no code chooses candidates. The work is the queries' number times the vectors'."""
    index = VectorIndex(df)
    askers = index.owners.filter(F.pmod(F.col("document"), F.lit(every)) == 0)
    lists = index.nearest(askers, k + 1)  # its own document is one of them
    near = skew_join(askers.select(F.col("vid").alias("x"), "document"), lists, "x", "inner").select("model_id", "dimensions", "document", F.explode("near").alias("near"))
    best = near.filter("document <> near.other").groupBy("model_id", "dimensions", "document", "near.other").agg(F.max("near.cosine").alias("cosine"))
    order = Window.partitionBy("model_id", "dimensions", "document").orderBy(F.desc("cosine"), "other")
    ranked = best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    return ranked.select("model_id", "dimensions", "document", F.col("n").alias("rank"), "other", "cosine")
