"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 7): every distinct pre-token is encoded once.

1. Texts are cut into pre-tokens a block (some million characters) at a time; a block's distinct pre-tokens get local numbers, and each
   text becomes its sequence of local numbers: the positions, pre-aggregated where they arise.
2. The blocks' distinct words are shuffled by word; each distinct word of the corpus is encoded once.
3. Ids are joined back to (block, local number) and meet their block's texts, which are reassembled by position.

Only words and numbers are shuffled, never occurrences as rows. The words of most blocks, of which there are at most HOT_WORDS, find their
ids by a broadcast of bounded size, so that a word in every text is a row for each block only where it is used.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.llm import kernel
from vaultframe.session import materialize, spread

#: Where the public vocabulary files are; a path all executors needn't have, as the driver reads the file and broadcasts it.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of a block's texts together; a longer text is a block of its own, cut into pre-tokens as many code points at a time.
BLOCK_CHARS = 1_000_000
#: Words that are broadcast, each of at most HOT_BYTES: those in the most blocks.
HOT_WORDS, HOT_BYTES = 16_384, 64
#: Ids that the assembly has in hand at once; a text of more is alone.
ASSEMBLED_IDS = 500_000
_END = 8
_GAP = re.compile(r"[A-Za-z0-9,;] (?=[A-Za-z0-9])")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pretokens(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, their code points, start and end of each pre-token of PATTERN, and how many each text has. Found by rules over
    character classes for all texts at once: runs of one class, one space drawn to the run after it, contractions."""
    joined, points, text_starts = kernel.join_texts(texts)
    kind = kernel.char_classes()[points]
    size = len(points)
    if not size:
        return joined, points, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    ends = text_starts[1:-1] - 1  # the line feeds between texts
    kind[ends] = _END
    start = np.ones(size + 1, bool)
    start[1:size] = kind[1:] != kind[:-1]
    start[ends] = True
    start[ends + 1] = True
    # a run of white space before something else leaves its last character, which a plain space gives to what follows
    after = np.flatnonzero(start[1:size] & (kind[:-1] == kernel.SPACE) & (kind[1:] != _END)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    # contractions: a lone apostrophe that no space was drawn to, before certain letters
    quote = np.flatnonzero((points == 0x27) & start[:size])
    quote = quote[quote + 1 < size]
    quote = quote[kind[quote + 1] == kernel.LETTER]
    first = points[quote + 1]
    second = points[np.minimum(quote + 2, size - 1)]
    more = (quote + 2 < size) & (kind[np.minimum(quote + 2, size - 1)] == kernel.LETTER)
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = more & (((np.isin(first, [ord("r"), ord("v")])) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l"))))
    start[quote[one | two] + 1] = False
    start[quote[one] + 2] = True
    start[quote[two] + 3] = True
    begin = np.flatnonzero(start[:size])
    stop = np.append(begin[1:], size)
    real = kind[begin] != _END
    begin, stop = begin[real], stop[real]
    return joined, points, begin, stop, np.diff(np.searchsorted(begin, text_starts))


def _segments(text: str, most: int) -> Iterator[str]:
    """A text cut into parts of about `most` code points where a pre-token surely begins whatever stands around it: at a space between
    two characters that are no white space. Without one the part goes on to the next."""
    start = 0
    while len(text) - start > most:
        gap = _GAP.search(text, start + most)
        if not gap:
            break
        yield text[start : gap.start() + 1]
        start = gap.start() + 1
    yield text[start:]


def block_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pre-tokens of some texts, the local number of each pre-token in order, and how many each text has. One text that is
    longer than a block is gone through in parts, so that only its pre-tokens' hashes are held whole."""
    parts = [texts] if len(texts) != 1 else [[t] for t in _segments(texts[0], BLOCK_CHARS)]
    hashes, words, counts = [], {}, np.zeros(len(texts), np.int64)
    for part in parts:
        joined, points, begin, stop, n = pretokens(part)
        counts += n
        if len(begin):
            hashed = kernel.span_hashes(points, begin, stop)
            distinct, first = np.unique(hashed, return_index=True)
            for h, a, b in zip(distinct.tolist(), begin[first].tolist(), stop[first].tolist()):
                if h not in words:
                    words[h] = joined[a:b]
            hashes.append(hashed)
    if not hashes:
        return [], np.zeros(0, np.int32), counts
    distinct, local = np.unique(np.concatenate(hashes) if len(hashes) > 1 else hashes[0], return_inverse=True)
    return [words[h] for h in distinct.tolist()], local.astype(np.int32), counts


def _cut(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to at most `most`; a longer one is alone."""
    start = size = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def _lengths(column: pa.Array) -> np.ndarray:
    """Bytes or items of each row of a string or list column; 0 for null."""
    return pc.fill_null(pc.binary_length(column) if pa.types.is_string(column.type) else pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each text (block, doc, places) and one for each block (block, words). A null text has no places."""
    kind = dict(df.dtypes)[key]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in _cut(_lengths(batch.column(1)), BLOCK_CHARS):
                words, local, counts = block_words(["" if t is None else t for t in batch.column(1).slice(a, b - a).to_pylist()])
                offsets = np.zeros(b - a + 2, np.int32)
                offsets[1:-1] = np.cumsum(counts)
                offsets[-1] = offsets[-2]
                last = np.arange(b - a + 1) == b - a
                word_offsets = np.zeros(b - a + 2, np.int32)
                word_offsets[-1] = len(words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a + 1, block)),
                        pa.concat_arrays([batch.column(0).slice(a, b - a), pa.nulls(1, batch.column(0).type)]),
                        pa.array(last),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(local)),
                        pa.ListArray.from_arrays(pa.array(word_offsets), pa.array(words, pa.string())),
                    ],
                    names=["block", "doc", "dictionary", "places", "words"],
                )
                block += 1

    return spread(df.select(F.col(key).alias("doc"), F.col(text).alias("text"))).mapInArrow(make, f"block bigint, doc {kind}, dictionary boolean, places array<int>, words array<string>")


_encodings: dict = {}


def _encoding(path: str, ranks: dict[bytes, int]):
    """The tokenizer of a vocabulary: built once a process, as its tables are large."""
    if path not in _encodings:
        import tiktoken

        _encodings.clear()
        _encodings[path] = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, blocks, ids) for each row of (word, blocks), by the vocabulary file at `path`."""
    shared = words.sparkSession.sparkContext.broadcast(read_ranks(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe = _encoding(path, shared.value)
            ids = [bpe.encode_ordinary(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=["word", "blocks", "ids"])

    return words.select("word", "blocks").mapInArrow(encode, "word string, blocks bigint, ids array<int>")


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids): each text as the ids of a byte-level BPE vocabulary, special strings taken as ordinary text.

    An empty and a null text both give an empty list. One row for each row of df, repeated keys included. Texts of any length are one
    row and one block; columns besides `key` and `text` are ignored; an empty table gives an empty result."""
    spark: SparkSession = df.sparkSession
    kind = dict(df.dtypes)[key]
    cut = materialize(blocks(df, key, text), "blocks")
    words = cut.filter("dictionary").select("block", F.posexplode("words").alias("local", "word"))
    known = materialize(encode_words(words.groupBy("word").agg(F.count(F.lit(1)).alias("blocks")), vocabulary or os.path.join(TOKENIZERS, VOCABULARY)), "words")
    hot = materialize(known.filter(F.octet_length("word") <= HOT_BYTES).orderBy(F.desc("blocks"), "word").limit(HOT_WORDS).select("word", "ids"), "hot-words")
    often = words.join(F.broadcast(hot), "word")
    seldom = words.join(F.broadcast(hot.select("word")), "word", "left_anti").join(known.select("word", "ids"), "word")
    numbered = often.unionByName(seldom).select("block", F.lit(None).cast(kind).alias("doc"), F.lit(0).alias("texts"), "local", "ids")
    texts = cut.filter(~F.col("dictionary")).select("block", "doc", F.lit(1).alias("texts"), F.lit(0).alias("local"), F.col("places").alias("ids"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = numbered.unionByName(texts).repartition(parts, "block").sortWithinPartitions("block", "texts", "local")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, sizes, begin, flat = None, [], None, None, None
        for batch in batches:
            of, is_text = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            limits = np.flatnonzero(np.diff(of) | np.diff(is_text)) + 1
            for a, b in zip([0, *limits], [*limits, len(of)]):
                if of[a] != block:  # sizes stays None until the block's first text
                    block, held, sizes, flat = of[a], [], None, None
                column = batch.column(4).slice(a, b - a)
                if not is_text[a]:
                    held.append((_lengths(column).astype(np.int32), column.flatten().to_numpy().copy()))
                    continue
                if sizes is None:
                    sizes = np.concatenate([n for n, _ in held]) if held else np.zeros(0, np.int32)
                    flat = np.concatenate([x for _, x in held]) if held else np.zeros(0, np.int32)
                    begin, held = np.cumsum(sizes) - sizes, []
                for low, high in _cut(_lengths(column), ASSEMBLED_IDS):
                    part = column.slice(low, high - low)
                    values = part.flatten().to_numpy()
                    count = sizes[values]
                    ends = np.cumsum(count)
                    ids = np.arange(int(ends[-1]) if len(ends) else 0)
                    ids += np.repeat(begin[values] - (ends - count), count)
                    at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(_lengths(part))))].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(a + low, high - low), pa.ListArray.from_arrays(pa.array(at), pa.array(flat[ids], pa.int32()))], names=[key, "ids"])

    return met.mapInArrow(assemble, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, key: str, ids: str, vocabulary: str | None = None) -> DataFrame:
    """(key, text): ids back to text by the table of the tokens' bytes, whose size is the vocabulary's. A null list gives an empty text; bytes
    that aren't UTF-8, as from a cut list, become U+FFFD. An id outside the vocabulary is an error."""
    ranks = read_ranks(vocabulary or os.path.join(TOKENIZERS, VOCABULARY))
    pieces = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        pieces[i] = b
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join([shared.value[i] for i in x or ()]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(join, f"`{key}` {dict(df.dtypes)[key]}, text string")
