"""Splitting oversized texts at natural boundaries (problem 4).

Every place where a text may be cut is a node: headings by level, blocks (blank lines), sentences and, where none of those is
near, spaces or character limits. Each node is joined to its farthest legal successor: the piece after a cut starts `overlap` bytes
before it and ends within the limit, at the farthest place of the strongest kind in the window's second half. Squaring the
successor table doubles the hops it spans, so that the cuts of all texts of a batch are marked in as many rounds as the logarithm
of the longest chain. The table is an array for each Arrow batch: a text's nodes are never apart, so nothing needs a shuffle but
the texts' headings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm.prose import flat_lines, scan_blocks

LIMIT, OVERLAP = 2000, 200
_BLOCK, _SENTENCE, _FILLER, _END = 7, 8, 9, 0
_SENTENCE_END = re.compile(rb"[.!?][\"')\]]*[ \t\n]+(?=\S)|\xe3\x80\x82")


def _char_start(body: bytes, at: int) -> int:
    """The first byte of the character that holds byte `at`."""
    while 0 < at < len(body) and body[at] & 0xC0 == 0x80:
        at -= 1
    return at


Block = tuple[int, int, int, bool]


def places(body: bytes, blocks: list[Block], step: int) -> dict[int, int]:
    """Where a body of these blocks may be cut, and how strong each place is (1-6 heading, 7 block, 8 sentence, 9 space or character). No two
    neighbouring places are more than about `step` bytes apart."""
    flat = flat_lines(body)
    out: dict[int, int] = {}
    for start, end, level, fenced in blocks:
        if start:
            out[start] = level or _BLOCK
        if fenced:
            at = flat.find(b"\n", start, end)
            while at >= 0:
                out.setdefault(at + 1, _SENTENCE)
                at = flat.find(b"\n", at + 1, end)
        else:
            for m in _SENTENCE_END.finditer(flat, start, end):
                if m.end() < end:
                    out.setdefault(m.end(), _SENTENCE)
    known = [0, *sorted(out), len(body)]
    for a, b in zip(known[:-1], known[1:]):
        last, at = a, a + step
        while at < b:
            space = max(flat.rfind(b" ", max(last + step // 2, at - step // 4), at), flat.rfind(b"\n", max(last + step // 2, at - step // 4), at))
            cut = space + 1 if space >= 0 else _char_start(body, at)
            if cut > last:
                out.setdefault(cut, _FILLER)
            last = max(cut, last + 1)
            at = last + step
    out.pop(0, None)
    out.pop(len(body), None)
    return out


def cuts(bodies: list[bytes], headings: list[list[tuple[int, int]]], limit: int, overlap: int) -> list[np.ndarray]:
    """The cuts of each body, 0 and its length included, and where the piece after each starts."""
    return block_cuts(bodies, [scan_blocks(b, h) for b, h in zip(bodies, headings)], limit, overlap)


def block_cuts(bodies: list[bytes], blocks: list[list[Block]], limit: int, overlap: int) -> list[np.ndarray]:
    """As `cuts`, of bodies whose blocks are known, by squaring successor tables over all bodies at once."""
    at, rank, starts, base, bases = [], [], [], 0, []
    offset = 0
    for body, own in zip(bodies, blocks):
        found = places(body, own, max(8, (limit - overlap) // 8))
        order = sorted(found)
        at += [offset, *(offset + p for p in order), offset + len(body)]
        rank += [_END, *(found[p] for p in order), _END]
        starts.append(base)
        base += len(order) + 2
        bases.append(offset)
        offset += len(body) + 2 * limit  # far enough that no window reaches the next body
    at, rank = np.array(at, np.int64), np.array(rank, np.int8)
    first = np.array(starts, np.int64)
    last = np.append(first[1:], len(at)) - 1
    owner = np.repeat(np.arange(len(bodies)), last - first + 1)
    begin, end = at[first][owner], at[last][owner]
    # where the piece after each cut starts: `overlap` bytes before it, at a character's first byte
    joined = b"\x00".join(bodies)
    shift = np.cumsum([0, *(len(b) + 1 for b in bodies[:-1])])[owner] - begin
    raw = np.frombuffer(joined, np.uint8)
    start = np.maximum(at - overlap, begin)
    for _ in range(3):
        inside = np.clip(start + shift, 0, max(0, len(raw) - 1))
        start = start - ((start > begin) & (raw[inside] & 0xC0 == 0x80))
    start[first] = at[first]
    # the farthest place of the strongest kind in the window's second half; the end, if the limit reaches it
    succ = np.full(len(at), -1, np.int64)
    for kind in range(1, _FILLER + 1):
        own = np.flatnonzero(rank == kind)
        if not len(own):
            continue
        k = np.searchsorted(at[own], start + limit, "right") - 1
        far = own[np.maximum(k, 0)]
        fits = (succ < 0) & (k >= 0) & (at[far] > np.maximum(at, start + limit // 2))
        succ[fits] = far[fits]
    # nothing in the second half: the farthest place of any kind
    far = np.searchsorted(at, start + limit, "right") - 1
    succ = np.where(succ < 0, np.maximum(far, np.arange(len(at))), succ)
    succ = np.where(end <= start + limit, last[owner], succ)
    assert ((succ > np.arange(len(at))) | (np.arange(len(at)) == last[owner])).all()
    reached = np.zeros(len(at), bool)
    reached[first] = True
    jump = succ
    while True:  # after k rounds all places up to 2**k - 1 cuts away are marked
        before = reached.sum()
        reached[jump[reached]] = True
        if reached.sum() == before:
            break
        jump = jump[jump]
    marked = np.flatnonzero(reached)
    parts = np.split(marked, np.searchsorted(marked, first[1:]))
    return [np.stack((at[p] - b, np.maximum(start[p] - b, 0))) for p, b in zip(parts, bases)]


def _with_headings(df: DataFrame, key: str, text: str, headings: DataFrame, limit: int) -> DataFrame:
    """(doc, body, heads) of the texts over the limit. Headings are few and small; repeated ones count once."""
    heads = (
        headings.filter("not inside_container and span_offset is not null")
        .groupBy(F.col("document").alias("doc"))
        .agg(F.collect_set(F.struct(F.col("span_offset").alias("o"), F.coalesce("level", F.lit(6)).cast("int").alias("l"))).alias("heads"))
    )
    long = df.select(F.col(key).alias("doc"), F.col(text).cast("binary").alias("body")).filter(F.octet_length("body") > limit)
    return long.join(heads, "doc", "left")


def _heads(column: pa.Array) -> list[list[tuple[int, int]]]:
    return [sorted({(h["o"], min(6, max(1, h["l"]))) for h in x or ()}) for x in column.to_pylist()]


def _chunked(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text."""
    offsets = batch.column(1).offsets if hasattr(batch.column(1), "offsets") else None
    sizes = [len(x) for x in batch.column(1).to_pylist()] if offsets is None else np.diff(offsets.to_numpy()).tolist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield batch.slice(start)


def block_sizes(df: DataFrame, key: str, text: str, headings: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, block_offset, size, level, cuts) of each block of the texts over `limit` bytes: the natural boundaries that `split` cuts at first,
    and how many of its cuts fall inside the block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _chunked(whole):
                bodies = batch.column(1).to_pylist()
                blocks = [scan_blocks(b, h) for b, h in zip(bodies, _heads(batch.column(2)))]
                rows, inside, at = [], [], []
                for i, (own, (stops, _)) in enumerate(zip(blocks, block_cuts(bodies, blocks, limit, overlap) if bodies else [])):
                    rows += own
                    inside.append(np.searchsorted(stops, [e for _, e, _, _ in own], "left") - np.searchsorted(stops, [s for s, _, _, _ in own], "right"))
                    at += [i] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())), pa.array([s for s, _, _, _ in rows], pa.int64()), pa.array([e - s for s, e, _, _ in rows], pa.int64()),
                        pa.array([v for _, _, v, _ in rows], pa.int32()), pa.array(np.maximum(np.concatenate([np.zeros(0, np.int64), *inside]), 0).astype(np.int32)),
                    ],
                    names=[key, "block_offset", "size", "level", "cuts"],
                )

    return _with_headings(df, key, text, headings, limit).mapInArrow(scan, f"`{key}` {dict(df.dtypes)[key]}, block_offset bigint, size bigint, level int, cuts int")


def oversized_blocks(df: DataFrame, key: str, text: str, headings: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, block_offset): blocks that are over the limit themselves. They are among those that a cut of `split` falls inside of, as what
    lies between two neighbouring cuts is within the limit."""
    return block_sizes(df, key, text, headings, limit).filter((F.col("cuts") > 0) & (F.col("size") > limit)).select(key, "block_offset")


def split(df: DataFrame, key: str, text: str, headings: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, start, new_from, stop, text): the ordered pieces of each text over `limit` bytes of UTF-8. Bytes [start, stop); `new_from`
    is where the piece before ended, `overlap` bytes after start (up to three more, so as not to cut a character).

    Null, empty and short texts give no rows. `headings` (document, span_offset, level, inside_container) may be empty, repeat rows,
    hold nulls or offsets outside the text. Repeated rows of df give repeated pieces. Texts are cut whole, however long; one
    without spaces or line ends is cut between characters. Other columns are ignored."""
    if not 0 <= overlap <= limit // 4 or limit < 64:
        raise ValueError("the overlap must be at most a quarter of the limit, and the limit at least 64")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _chunked(whole):
                bodies = batch.column(1).to_pylist()
                at, rows = [], []
                for i, (body, (stops, starts)) in enumerate(zip(bodies, cuts(bodies, _heads(batch.column(2)), limit, overlap))):
                    for k in range(len(stops) - 1):
                        a, b = int(starts[k]), int(stops[k + 1])
                        rows.append((k, a, int(stops[k]), b, body[a:b].decode("utf-8", "replace")))
                    at += [i] * (len(stops) - 1)
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4]), pa.array(cols[4], pa.string())],
                    names=[key, "piece", "start", "new_from", "stop", "text"],
                )

    return _with_headings(df, key, text, headings, limit).mapInArrow(cut, f"`{key}` {dict(df.dtypes)[key]}, piece int, start bigint, new_from bigint, stop bigint, text string")
