"""Filling fixed-capacity containers (problem 8): vector bin packing by the dot-product heuristic.

Items have three sizes: tokens, segments and loss-bearing tokens, each with a limit a container. The open container takes the
item whose demand points most along what is left in it (largest weighted dot product among those that fit), until none fits. Items
of equal sizes are one kind, so a step compares kinds and not items. Items are spread at random over groups of bounded size that are
packed apart: a group wastes at most about its last container.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.llm import encoding
from vaultframe.session import materialize

CAPACITY = 2048
#: Items packed together in one task.
GROUP_ITEMS = 25_000


def token_sizes(df: DataFrame, key: str, text: str, loss_from: Column | None = None, vocabulary: str | None = None) -> DataFrame:
    """(key, tokens, loss): each text's tokens, and those that reach beyond byte `loss_from` (by default all) and so bear loss."""
    ranks = encoding.read_ranks(vocabulary or os.path.join(encoding.TOKENIZERS, encoding.VOCABULARY))
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for b, i in ranks.items():
        widths[i] = len(b)
    shared = df.sparkSession.sparkContext.broadcast(widths)
    start = F.coalesce(loss_from.cast("bigint"), F.lit(0).cast("bigint")) if loss_from is not None else F.lit(0).cast("bigint")
    keyed = df.select(F.struct(F.col(key).alias("id"), start.alias("start")).alias("k"), F.col(text).alias("text"))
    ids = encoding.encode(keyed, "k", "text", vocabulary)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy()[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            tokens = np.diff(offsets)
            owner = np.repeat(np.arange(len(tokens)), tokens)
            ends = np.cumsum(shared.value[values])
            before = np.concatenate(([0], ends))[offsets[:-1]]
            bears = (ends - before[owner]) > batch.column(1).to_numpy()[owner]
            loss = np.bincount(owner[bears], minlength=len(tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens.astype(np.int64)), pa.array(loss.astype(np.int64))], names=[key, "tokens", "loss"])

    return ids.select("k.id", "k.start", "ids").mapInArrow(measure, f"`{key}` {dict(df.dtypes)[key]}, tokens bigint, loss bigint")


def fill(tokens: np.ndarray, segments: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """The container number of each item, by the dot-product heuristic. Every item must fit an empty container."""
    sizes = np.stack((tokens, segments, loss), 1).astype(np.int64)
    kinds, of, left = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)  # by tokens, rising
    queue = np.argsort(of.reshape(-1), kind="stable")
    nth = np.cumsum(left) - left
    out = np.zeros(len(sizes), np.int64)
    limit = np.array(limits, np.int64)
    share = kinds / np.maximum(limit, 1)
    pull = share * (share * left[:, None]).sum(0) / max(1, len(sizes))  # scarcer sizes count for more
    alone = pull.sum(1)  # the score in an empty container, where all of every limit is left
    number = np.arange(len(kinds))
    container, rest, remaining, gone = 0, limit.copy(), len(sizes), 0
    while remaining:
        if gone * 2 > len(number):  # forget kinds that are used up
            live, gone = left[number] > 0, 0
            number, kinds, pull, alone = number[live], kinds[live], pull[live], alone[live]
        fits = int(np.searchsorted(kinds[:, 0], rest[0], "right"))
        if (rest == limit).all():
            score = np.where(left[number[:fits]] > 0, alone[:fits], -1.0)
        else:
            ok = (left[number[:fits]] > 0) & (kinds[:fits, 1] <= rest[1]) & (kinds[:fits, 2] <= rest[2])
            score = np.where(ok, pull[:fits] @ (rest / np.maximum(limit, 1)), -1.0)
        best = int(np.argmax(score)) if fits else 0
        if not fits or score[best] < 0:
            container, rest = container + 1, limit.copy()
            continue
        k = number[best]
        take = 1 if kinds[best].any() else int(left[k])  # items of no size all go where the first does
        out[queue[nth[k] : nth[k] + take]] = container
        nth[k] += take
        left[k] -= take
        remaining -= take
        gone += left[k] == 0
        rest = rest - kinds[best]
    return out


def pack(items: DataFrame, key: str, capacity: int = CAPACITY, max_segments: int = 64, max_loss: int | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(key, part, container, start, tokens, loss): items (key, tokens, loss) assigned to containers of `capacity` tokens, at most `max_segments` items
    and `max_loss` loss-bearing tokens (by default `capacity`). `start` is the item's first token within the container.

    An item is split only if it is over the capacity (or, in loss, over max_loss): into parts of the capacity and a rest. An item
    of no tokens takes no room and gets a container like any other. Null sizes count as 0. Repeated keys are items of their own.
    An empty table gives an empty result; other columns are ignored."""
    most = max_loss or capacity
    if min(capacity, max_segments, most) < 1:
        raise ValueError("limits must be positive")
    piece = min(capacity, most)
    kind = dict(items.dtypes)[key]
    sized = items.select(F.col(key).alias("item"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.least(F.coalesce("loss", F.lit(0)).cast("bigint"), F.coalesce("tokens", F.lit(0)).cast("bigint")).alias("loss"))
    over = (F.col("tokens") > capacity) | (F.col("loss") > most)
    parts = F.when(over, F.ceil(F.col("tokens") / piece)).otherwise(1).cast("int")
    begin = F.col("part").cast("bigint") * piece
    cut = sized.withColumn("over", over).withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))))
    end = F.when(F.col("over"), F.least(begin + piece, F.col("tokens"))).otherwise(F.col("tokens"))
    rows = materialize(cut.select("item", "part", (end - begin).alias("tokens"), F.greatest(F.lit(0), end - F.greatest(begin, F.col("tokens") - F.col("loss"))).alias("loss")), "items")
    groups = max(1, -(-rows.count() // group_items))
    # the rows are written, so their numbers stand; equal items, and items without a key, are spread like any others
    spread = rows.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def fill_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "item", "part"], ascending=[False, True, True], kind="stable")
        n = pdf["tokens"].to_numpy()
        # loss is part of the tokens, so a limit on it of the whole capacity can't bind and needn't tell kinds apart
        loss = pdf["loss"].to_numpy() if most < capacity else np.zeros(len(n), np.int64)
        at = fill(n, (n > 0).astype(np.int64), loss, (capacity, max_segments, most))
        pdf = pdf.assign(container=(int(pdf["grp"].iloc[0]) << 32) + at)
        pdf["start"] = pdf.groupby("container")["tokens"].cumsum() - pdf["tokens"]
        return pdf.rename(columns={"item": key})[[key, "part", "container", "start", "tokens", "loss"]]

    return spread.repartition(groups, "grp").groupBy("grp").applyInPandas(fill_group, f"`{key}` {kind}, part int, container bigint, start bigint, tokens bigint, loss bigint")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, items, tokens, filled): how full the containers are."""
    boxes = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("i"))
    return boxes.agg(F.count(F.lit(1)).alias("containers"), F.sum("i").alias("items"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("filled"))
