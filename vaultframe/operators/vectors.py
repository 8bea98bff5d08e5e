"""Embedding by hashed words, nearest vectors and staleness. Never imported by findings or plans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.session import slices, spread

# FNV-1a over 64 bits and a finaliser.
_BASIS, _PRIME = 0xCBF29CE484222325, 0x00000100000001B3
_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))


def _absorb(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return (state ^ byte.astype(np.uint64)) * np.uint64(_PRIME)


def model_seed(model_id: str, version: str) -> np.uint64:
    state = np.array([_BASIS], np.uint64)
    for part in (model_id.encode(), version.encode()):
        for b in len(part).to_bytes(8, "little") + part:
            state = _absorb(state, np.array([b]))
    return state[0]


def _buckets(hashes: np.ndarray, width: int) -> np.ndarray:
    h = hashes.copy()
    for shift, factor in _MIX:
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return (h % np.uint64(width)).astype(np.int64)


def embed_batch(texts: list[str], model_id: str = "stub", version: str = "2", width: int = 64) -> np.ndarray:
    """Unit vectors: counts of hashed tokens and of the model's own feature. Tokens are runs of ASCII letters and digits and of all
    non-ASCII bytes, lower-cased over ASCII; all tokens of a batch are hashed a byte place at a time."""
    raw = np.frombuffer(b"\n".join(t.encode() for t in texts) + b"\n", np.uint8)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    inside = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    starts = np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])
    owner = np.searchsorted(starts, begin, "right") - 1
    seed = model_seed(model_id, version)
    state = np.full(len(begin), seed, np.uint64)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max()) if len(size) else 0
    ends = np.searchsorted(-size[order], -np.arange(longest), "left")  # how many tokens are longer than k
    for k in range(longest):
        live = order[: ends[k]]
        state[live] = _absorb(state[live], raw[begin[live] + k])
    counts = np.bincount(owner * width + _buckets(state, width), minlength=len(texts) * width).reshape(len(texts), width)
    counts[:, _buckets(np.array([seed]), width)[0]] += 1
    norms = np.sqrt((counts.astype(np.int64) ** 2).sum(axis=1).astype(np.float64)).astype(np.float32)
    return counts.astype(np.float32) / norms[:, None]


class Embedder(Protocol):
    """What turns texts into vectors: a model's name and version, its dimensions, and a batch of texts to a (texts, dimensions) float32 array. It must
    give a text the same vector in any batch, and be picklable, as executors call it."""

    model: str
    version: str
    dimensions: int

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashedWords:
    """The built-in embedder: `embed_batch`."""

    model: str = "stub"
    version: str = "2"
    dimensions: int = 64

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        return embed_batch(texts, self.model, self.version, self.dimensions)


#: Bytes of text that an embedder is given at once.
EMBED_BYTES = 1_000_000


def embed(df: DataFrame, key: str, text: str, embedder: Embedder = HashedWords()) -> DataFrame:
    """(key, embedding): a null text has a null embedding, any other one of the embedder's dimensions."""
    size = embedder.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, EMBED_BYTES):
            texts = batch.column(1).to_pylist()
            found = embedder.embed_batch([t or "" for t in texts]) if texts else np.zeros((0, size), np.float32)
            if found.shape != (len(texts), size):
                raise ValueError(f"the embedder gave {found.shape} for {(len(texts), size)}")
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * size), pa.array(found.astype(np.float32).ravel()), mask=pc.is_null(batch.column(1)) if batch.column(1).null_count else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[key, "embedding"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>")


def vector_rows(df: DataFrame, key: str, text: str, content_hash: str, generation: int, embedder: Embedder = HashedWords()) -> DataFrame:
    """Rows of document_vectors of documents with a text: (document, model_id, model_version, content_hash, dimensions, embedding, generation)."""
    hashed = df.select(key, F.col(content_hash).alias("content_hash"))
    rows = embed(df, key, text, embedder).filter("embedding is not null").join(hashed, key)
    return rows.select(F.col(key).alias("document"), F.lit(embedder.model).alias("model_id"), F.lit(embedder.version).alias("model_version"), "content_hash", F.lit(embedder.dimensions).alias("dimensions"), "embedding", F.lit(generation).cast("bigint").alias("generation"))


def stored(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """What an upsert by (document, model_id, model_version) keeps of vector rows: the latest generation, of known documents only."""
    rest = [c for c in rows.columns if c not in ("document", "model_id", "model_version", "generation")]
    last = rows.groupBy("document", "model_id", "model_version").agg(F.max(F.struct("generation", *rest)).alias("m"))
    return last.join(documents.select(F.col("doc_id").alias("document")), "document", "left_semi").select("document", "model_id", "model_version", "m.*")


def stale(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Vector rows whose document's content has another hash now."""
    now = documents.select(F.col("doc_id").alias("document"), F.col("content_hash").alias("_now"))
    return rows.join(now, "document").filter(F.col("content_hash") != F.col("_now")).drop("_now")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(df: DataFrame, key: str, embedding: str, query: list[float], k: int) -> DataFrame:
    """(key, cosine): the k rows nearest to one query vector, ties by key. One scan; each task keeps its k best."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(key, F.round(cosine(F.col(embedding), q), 9).alias("cosine")).orderBy(F.desc("cosine"), key).limit(k)
