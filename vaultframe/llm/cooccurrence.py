"""Items that appear together (problem 3): exact pair counts against a fitted bipartite null.

The null is the bipartite configuration model: item i is in basket b with probability x_i y_b / (1 + x_i y_b), the fitnesses such that
every item's frequency and every basket's size are met on average. Items of equal frequency have equal fitness, and so have baskets
of equal size: the fit needs only the two histograms, binned above a bound. A pair's count is then a sum of independent draws, one for each
basket; its upper tail is computed exactly (exponentially tilted, by discrete Fourier inversion), and false discoveries are controlled over
all pairs by Benjamini and Hochberg's rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.session import materialize, skew_join

#: A basket's items are paired in blocks of about this many, so that no task holds a whole basket.
BLOCK = 256
#: The histograms that the null is fitted on: counts below EXACT one by one, then PER_OCTAVE bins for each doubling.
EXACT, PER_OCTAVE = 256, 64
#: Tails that a task remembers.
KNOWN = 200_000


def pair_counts(rows: DataFrame, least: int) -> DataFrame:
    """(a, b, together): of distinct (basket, item) rows, the baskets that hold both items, a < b, where at least `least`.

    A basket of up to BLOCK items is one group. A larger one is cut into blocks by item, and each pair of blocks is a group of its own."""
    sizes = rows.groupBy("basket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    big = sizes.filter("blocks > 1")
    placed = skew_join(rows, big, "basket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.hash("item"), F.col("blocks")))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "basket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("item", "block").alias("m")
    )
    groups = spread.groupBy("basket", "i", "j").agg(F.array_sort(F.collect_set("m")).alias("ms")).filter(F.size("ms") > 1)
    pairs = groups.select("i", "j", "ms", F.posexplode("ms").alias("at", "left")).select(
        "i", "j", F.col("left.item").alias("a"), F.col("left.block").alias("block"), F.explode(F.slice("ms", F.col("at") + 2, F.greatest(F.size("ms") - F.col("at") - 1, F.lit(0)))).alias("right")
    )
    own = (F.col("i") == F.col("j")) | (F.col("block") != F.col("right.block"))
    return pairs.filter(own).groupBy("a", F.col("right.item").alias("b")).agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= least)


def histogram(values: DataFrame, column: str) -> dict[float, int]:
    """Rows by value of a column of positive counts. Values below EXACT stand for themselves; larger ones share PER_OCTAVE bins an octave, each
    under its mean. So the driver gets some thousand rows at most, whatever the counts; a bin's values differ by about 1 %."""
    n = F.col(column)
    bin_ = F.when(n < EXACT, n.cast("double")).otherwise(EXACT + F.floor((F.log2(n) - math.log2(EXACT)) * PER_OCTAVE))
    return {r["mean"]: r["rows"] for r in values.groupBy(bin_.alias("bin")).agg(F.avg(n).alias("mean"), F.count(F.lit(1)).alias("rows")).collect()}


def fit_null(frequencies: dict[float, int], sizes: dict[float, int], rounds: int = 2000, tolerance: float = 1e-10) -> tuple[dict[float, float], np.ndarray, np.ndarray]:
    """Fitness by item frequency, rising; fitness and number of baskets by basket size. Fixed point on the two histograms."""
    k, t = np.array(sorted(frequencies), float), np.array([frequencies[x] for x in sorted(frequencies)], float)
    s, m = np.array(sorted(sizes), float), np.array([sizes[x] for x in sorted(sizes)], float)
    total = max(1.0, float((k * t).sum()))
    x, y = k / math.sqrt(total), s / math.sqrt(total)
    for _ in range(rounds):
        new_x = k / (m * y / (1 + np.outer(x, y))).sum(1)
        new_y = s / (t[:, None] * new_x[:, None] / (1 + np.outer(new_x, y))).sum(0)
        change = max(np.abs(new_x / x - 1).max(), np.abs(new_y / y - 1).max())
        x, y = new_x, new_y
        if change < tolerance:
            break
    return dict(zip(k.tolist(), x.tolist())), y, m


def log_upper_tail(q: np.ndarray, m: np.ndarray, c: int) -> float:
    """log P(S >= c), S the sum of m[i] Bernoulli(q[i]) draws each. Exact up to rounding, however small."""
    if c <= 0:
        return 0.0
    if c > m.sum():
        return -math.inf
    keep = (q > 0) & (m > 0)
    q, m = q[keep], m[keep]
    if c > m.sum():
        return -math.inf
    if c == m.sum():
        return float((m * np.log(q)).sum())
    theta, mean = 0.0, float((m * q).sum())
    if c > mean:  # tilted so that c is about the mean; how closely changes nothing but the rounding
        theta = math.log(c / mean)
        for _ in range(50):
            p = q / (q + (1 - q) * math.exp(-theta))
            off = c - float((m * p).sum())
            if abs(off) < 1e-3 * math.sqrt(c):
                break
            theta += max(-3.0, min(3.0, off / max(1e-300, float((m * p * (1 - p)).sum()))))
    p = q / (q + (1 - q) * np.exp(-theta))
    spread = math.sqrt(float((m * p * (1 - p)).sum()))
    width = 2 * (int(9 * spread) + 24)  # what lies beyond weighs less than rounding
    start = max(0, c - width // 2)
    angle = 2 * np.pi * np.arange(width // 2 + 1) / width  # the other half is its mirror, as the masses are real
    logs = (m[:, None] * np.log(1 + p[:, None] * np.expm1(1j * angle)[None, :])).sum(0)
    mass = np.fft.irfft(np.conj(np.exp(logs - 1j * angle * start)), width)
    upper = np.maximum(mass[c - start :], 0)
    tail = float((upper * np.exp(-theta * np.arange(len(upper)))).sum())
    scale = float((m * np.log1p(q * np.expm1(theta))).sum()) - theta * c if theta < 500 else float((m * (theta + np.log(q))).sum()) - theta * c
    return min(0.0, scale + math.log(max(tail, 1e-300)))


def associations(df: DataFrame, basket: str, item: str, min_count: int = 5, min_lift: float = 0.0, fdr: float = 0.01) -> DataFrame:
    """(item_a, item_b, together, n_a, n_b, lift, expected, log_p, significant), item_a < item_b: item pairs found together in at least `min_count`
    baskets and at least `min_lift` times as often as independence gives (together * N >= min_lift * n_a * n_b, N the baskets that have a row).

    `expected` and `log_p` (natural logarithm of the chance of as many or more) are those of the null; `significant` holds false discoveries
    among all pairs of items that occur min_count times at `fdr`; pairs found together less often count as tests and never as finds.
    With a `min_lift` pairs are chosen by surprise: log_p must be at most that of the least count that reaches min_count and min_lift for
    items as frequent, which no pair with more fails, as tails fall with the count; the ratio itself is checked after.

    An item counts once a basket. Null items are in no pair, but their basket counts; null baskets are ignored. Items that can't be in any
    result, by n < min_count or min_lift * n > N, are left out before pairs are made: that loses none. An empty table gives
    an empty result. Other columns are ignored. Item frequencies and basket sizes of EXACT or more stand for their bin's in the null,
    which moves `expected` by about 1 % at most; counts are exact."""
    spark = df.sparkSession
    all_rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).filter("basket is not null").distinct()
    rows = materialize(all_rows, "baskets")
    baskets = rows.select("basket").distinct().count()
    named = rows.filter("item is not null")
    counts = materialize(named.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "items")
    frequencies = histogram(counts, "n")
    sizes = histogram(named.groupBy("basket").agg(F.count(F.lit(1)).alias("s")), "s")
    able = counts.filter((F.col("n") >= min_count) & (F.lit(float(min_lift)) * F.col("n") <= baskets))
    kept = skew_join(named, able.select("item"), "item", "left_semi")
    found = (
        pair_counts(kept, min_count)
        .join(able.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a")
        .join(able.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
    )
    fitness, y, m = fit_null(frequencies, sizes) if frequencies else ({}, np.zeros(0), np.zeros(0))
    null = spark.sparkContext.broadcast((np.log(list(fitness)), np.log(list(fitness.values())), y, m))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_k, log_x, y, m = null.value
        known: dict[tuple, tuple[float, float, float]] = {}
        for batch in batches:
            out = []
            for na, nb, c in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                at = (min(na, nb), max(na, nb), c)
                if at not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    xa, xb = np.exp(np.interp(np.log([na, nb]), log_k, log_x))
                    q = (xa * y / (1 + xa * y)) * (xb * y / (1 + xb * y))
                    log_p = log_upper_tail(q, m, c)
                    enough = max(min_count, math.ceil(min_lift * na * nb / baskets - 1e-9))
                    known[at] = (float((m * q).sum()), log_p, log_p if c == enough or not min_lift else log_upper_tail(q, m, enough))
                out.append(known[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([o[i] for o in out], pa.float64()) for i in range(3))], names=["a", "b", "n_a", "n_b", "together", "expected", "log_p", "enough"])

    kind = dict(df.dtypes)[item]
    judged = found.select("a", "b", "n_a", "n_b", "together").mapInArrow(test, f"a {kind}, b {kind}, n_a bigint, n_b bigint, together bigint, expected double, log_p double, enough double")
    # rounding moves a tail's logarithm by far less than what is allowed for here
    surprising = judged.filter(F.col("log_p") <= F.col("enough") + 1e-6 * (1 + F.abs("enough"))) if min_lift else judged
    tested = materialize(surprising.filter(F.col("together") * F.lit(float(baskets)) >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b")).drop("enough"), "pairs")
    usual = counts.filter(F.col("n") >= min_count).count()
    bound = discovery_bound(tested, "log_p", usual * (usual - 1) // 2, fdr)
    return tested.select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), "together", "n_a", "n_b", (F.col("together") * F.lit(float(baskets)) / (F.col("n_a") * F.col("n_b"))).alias("lift"), "expected", "log_p", (F.col("log_p") <= bound).alias("significant")
    )


def discovery_bound(tested: DataFrame, log_p: str, tests: int, fdr: float) -> float:
    """The largest log p that Benjamini and Hochberg's step-up rule rejects over `tests` tests, -inf if none: the greatest fixed point of
    R = #(p <= fdr R / tests), reached from above by counting. No ranking, no sort."""
    rejected = tests
    while rejected:
        bound = math.log(fdr) + math.log(rejected) - math.log(tests)
        now = tested.filter(F.col(log_p) <= bound).count()
        if now >= rejected:
            return bound
        rejected = now
    return -math.inf
