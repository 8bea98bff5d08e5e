"""Full text: a diacritic-folding tokenizer, postings with positions, boolean and phrase matching as joins and aggregates."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.session import spread

_RUN = regex.compile(r"[\p{L}\p{N}]+")


def fold(text: str) -> str:
    """Lower-cased, without combining marks, composed again."""
    low = text.lower()
    if low.isascii():
        return low
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", low) if unicodedata.category(c)[0] != "M"))


def tokens(text: str) -> list[str]:
    return _RUN.findall(fold(text))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, doc, positions): a row for each distinct term of a text. Null texts have none. Narrow; terms are counted where they stand."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, at, places = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found: dict[str, list[int]] = {}
                for k, w in enumerate(tokens(t) if t else ()):
                    found.setdefault(w, []).append(k)
                terms += found
                places += found.values()
                at += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["term", "doc", "positions"])

    return spread(df.select(key, text)).mapInArrow(index, f"term string, doc {dict(df.dtypes)[key]}, positions array<int>")


def vocabulary(index: DataFrame) -> DataFrame:
    """(term, documents, occurrences)."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).cast("bigint").alias("occurrences"))


def match_all(index: DataFrame, words: list[str]) -> DataFrame:
    """(doc): documents with every word."""
    asked = sorted({w for x in words for w in tokens(x)})
    return index.filter(F.col("term").isin(asked)).groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(asked)).select("doc")


def match_any(index: DataFrame, words: list[str]) -> DataFrame:
    return index.filter(F.col("term").isin([w for x in words for w in tokens(x)])).select("doc").distinct()


def match_not(index: DataFrame, words: list[str], without: list[str]) -> DataFrame:
    return match_all(index, words).join(match_any(index, without), "doc", "left_anti")


def _shift(k: int):
    return lambda p: p - k


def match_phrase(index: DataFrame, phrase: str) -> DataFrame:
    """(doc): documents that have the words one after another. Each word's positions are shifted to the phrase's start and intersected."""
    asked = tokens(phrase)
    out = None
    for k, w in enumerate(asked):
        starts = index.filter(F.col("term") == w).select("doc", F.transform("positions", _shift(k)).alias(f"p{k}"))
        out = starts.withColumnRenamed("p0", "starts") if out is None else out.join(starts, "doc").select("doc", F.array_intersect("starts", f"p{k}").alias("starts"))
    return out.filter(F.size("starts") > 0).select("doc")


def documents(hits: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that a match found, in path order."""
    return docs.join(hits.select(F.col("doc").alias(key)), key, "left_semi").orderBy("path")


def drift(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """(side, rows): postings that only the stored or only the derived index has."""
    only = lambda a, b, side: a.exceptAll(b).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(side).alias("side"), "rows")
    return only(stored, derived, "stored").unionByName(only(derived, stored, "derived"))
