"""Reading level (problem 9): graded examples clamped on a document-word graph, difficulty propagated by harmonic iterations.

Each document with prose is joined to the words of its prose, hashed into 2 ** WORD_BITS nodes, and to style nodes: the cells around its
letters a word and words a sentence on a logarithmic grid. Half of a document's weight is on style, half on words, a word's by its
share of the text and damped by how common it is, so that function words don't pull all texts to the mean. A node's difficulty
is the weighted mean of its documents', a document's that of its nodes; graded documents keep their grade and weigh GRADED_WEIGHT times
as much. Node scores are a vector of fixed length: each iteration is one pass over the documents, summed on the executors; they end when no
document could move by more than TOLERANCE, on average over its nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.llm import kernel, prose
from vaultframe.session import materialize, slices, spread

WORD_BITS = 16
#: The style grid: cells of a factor 2 ** (1 / GRID), GRID_SIDE along each measure.
GRID, GRID_SIDE = 4, 32
STYLE_SHARE = 0.5
#: How many times a graded document counts for a node what another does, as the only kind that brings anything in.
GRADED_WEIGHT = 25.0
#: Iterations end when the nodes' mean change, weighted by their edges, is below TOLERANCE grades, or after ITERATIONS.
TOLERANCE, ITERATIONS = 0.005, 60
_NODES = (1 << WORD_BITS) + GRID_SIDE * GRID_SIDE
_CHUNK_BYTES = 2_000_000


def _style(letters: np.ndarray, pace: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four grid cells around each document's measures and their bilinear weights."""
    x = np.clip(np.log2(np.maximum(letters, 1)) * GRID, 0, GRID_SIDE - 2)
    y = np.clip(np.log2(np.maximum(pace, 1)) * GRID, 0, GRID_SIDE - 2)
    i, j = x.astype(np.int64), y.astype(np.int64)
    u, v = x - i, y - j
    cells = np.stack([i * GRID_SIDE + j, i * GRID_SIDE + j + 1, (i + 1) * GRID_SIDE + j, (i + 1) * GRID_SIDE + j + 1], 1)
    return (1 << WORD_BITS) + cells, np.stack([(1 - u) * (1 - v), (1 - u) * v, u * (1 - v), u * v], 1)


def features(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, words, letters, sentences, nodes, counts): the prose measures of each text and its words by node. A text without prose
    (null, empty, only lists and the like) has zeros and no nodes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, _CHUNK_BYTES):
            n, letters, sentences, hashes = prose.measures(["" if t is None else t for t in batch.column(1).to_pylist()])
            owner = np.repeat(np.arange(len(n)), n)
            pair, tf = np.unique((owner.astype(np.uint64) << np.uint64(WORD_BITS)) | (hashes >> np.uint64(64 - WORD_BITS)), return_counts=True)
            offsets = np.searchsorted(pair >> np.uint64(WORD_BITS), np.arange(len(n) + 1).astype(np.uint64)).astype(np.int32)
            nodes = (pair & np.uint64((1 << WORD_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(x.astype(np.int64)) for x in (n, letters, sentences)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(nodes)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int32))),
                ],
                names=["doc", "words", "letters", "sentences", "nodes", "counts"],
            )

    return spread(df.select(F.col(key).alias("doc"), F.col(text).alias("text"))).mapInArrow(make, f"doc {dict(df.dtypes)[key]}, words bigint, letters bigint, sentences bigint, nodes array<int>, counts array<int>")


def _edges(batch: pa.RecordBatch, damping: np.ndarray, style_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a batch of features: document, node, weight (summing to one for each document with prose), and which have prose."""
    words, letters, sentences = (batch.column(i).to_numpy().astype(float) for i in (0, 1, 2))
    nodes, counts = batch.column(3), batch.column(4)
    offsets = nodes.offsets.to_numpy()
    node = nodes.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    tf = counts.values.to_numpy()[counts.offsets.to_numpy()[0] : counts.offsets.to_numpy()[-1]]
    owner = np.repeat(np.arange(len(words)), np.diff(offsets))
    weight = np.log1p(tf) * damping[node]
    total = np.bincount(owner, weight, len(words))
    weight *= (1 - style_share) / np.maximum(total, 1e-300)[owner]
    has = words > 0
    cells, shares = _style(letters / np.maximum(words, 1), words / np.maximum(sentences, 1))
    at = np.flatnonzero(has)
    owner = np.concatenate((owner, np.repeat(at, 4)))
    node = np.concatenate((node, cells[at].ravel()))
    return owner, node, np.concatenate((weight, style_share * shares[at].ravel())), has


def _summed(rows: DataFrame, per_task, width: int) -> np.ndarray:
    """Sums vectors of `width` doubles that each task makes of its batches: added on executors in slices, the sum alone is collected."""
    slices = 8
    step = -(-width // slices)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slices * step)
        for batch in batches:
            total[:width] += per_task(batch)
        parts = total.reshape(slices, step)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "sums"])

    out = np.zeros((slices, step))
    for r in rows.mapInArrow(make, "slice int, sums binary").repartition(slices, "slice").mapInArrow(add, "slice int, sums binary").collect():
        out[r["slice"]] = np.frombuffer(r["sums"])
    return out.reshape(-1)[:width]


class Difficulty:
    """Node scores of a corpus' document-word graph. `scores` is null if there are no grades; `residuals` has the nodes' mean change by
    iteration. `graph` has (words, letters, sentences, nodes, counts, grade) of the documents with prose."""

    def __init__(self, graph: DataFrame, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, style_share: float = STYLE_SHARE) -> None:
        def frequency(batch: pa.RecordBatch) -> np.ndarray:
            nodes = batch.column(0).flatten().to_numpy()
            return np.append(np.bincount(nodes, minlength=_NODES).astype(float), batch.num_rows)

        seen = _summed(graph.select("nodes"), frequency, _NODES + 1)
        self.damping, self.style_share, self.residuals = np.log(1 + seen[-1] / np.maximum(seen[:-1], 1)), style_share, []
        mean = graph.agg(F.avg("grade")).collect()[0][0]
        self.scores = None if mean is None else np.full(_NODES, mean)
        for _ in range(iterations if mean is not None else 0):
            self._iterate(graph)
            if self.residuals[-1] < tolerance:
                break

    def _iterate(self, graph: DataFrame) -> None:
        state, style_share = graph.sparkSession.sparkContext.broadcast((self.scores, self.damping)), self.style_share

        def step(batch: pa.RecordBatch) -> np.ndarray:
            scores, damping = state.value
            owner, node, weight, _ = _edges(batch, damping, style_share)
            given = batch.column(5).to_numpy(zero_copy_only=False).astype(float)
            # a document's edge weights sum to one, so its own mean is the plain sum
            own = np.bincount(owner, weight * scores[node], batch.num_rows)
            own = np.where(np.isnan(given), own, given)
            pull = weight * np.where(np.isnan(given), 1.0, GRADED_WEIGHT)[owner]
            return np.concatenate((np.bincount(node, pull * own[owner], _NODES), np.bincount(node, pull, _NODES)))

        sums = _summed(graph, step, 2 * _NODES)
        pull = sums[_NODES:]
        new = np.where(pull > 0, sums[:_NODES] / np.maximum(pull, 1e-300), self.scores)
        self.residuals.append(float((np.abs(new - self.scores) * pull).sum() / max(pull.sum(), 1e-300)))
        self.scores = new
        state.unpersist()


def reading_level(df: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, grade: str, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, style_share: float = STYLE_SHARE) -> DataFrame:
    """(key, words, letters, sentences, difficulty, graded): the prose measures of each text, and its difficulty on the scale of the grades.

    A document graded more than once, or by raters who disagree, is clamped at the mean of its grades; null grades and grades of
    unknown documents count for nothing. `difficulty` of a graded document is its estimate by its neighbours, like any other's. Without
    prose it is null, and so for all if there are no grades. One row for each row of df; extra columns are ignored, an empty
    table gives an empty result. Texts are read whole. `style_share` is the part of a document's weight that is on style, not on words."""
    clamp = labels.filter(F.col(grade).isNotNull()).groupBy(F.col(label_key).alias("doc")).agg(F.avg(F.col(grade).cast("double")).alias("grade"))
    facts = materialize(features(df, key, text).join(clamp, "doc", "left"), "reading")
    fitted = Difficulty(facts.select("words", "letters", "sentences", "nodes", "counts", "grade").filter("words > 0"), iterations, tolerance, style_share)
    known = fitted.scores is not None
    final = df.sparkSession.sparkContext.broadcast((fitted.scores if known else np.zeros(_NODES), fitted.damping))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, damping = final.value
        for batch in batches:
            inner = pa.RecordBatch.from_arrays([batch.column(i) for i in range(1, 6)], names=["a", "b", "c", "d", "e"])
            owner, node, weight, has = _edges(inner, damping, style_share)
            level = np.bincount(owner, weight * scores[node], batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(level, mask=~has | (not known)), batch.column(6).is_valid()], names=[key, "words", "letters", "sentences", "difficulty", "graded"])

    return facts.select("doc", "words", "letters", "sentences", "nodes", "counts", "grade").mapInArrow(estimate, f"`{key}` {dict(df.dtypes)[key]}, words bigint, letters bigint, sentences bigint, difficulty double, graded boolean")
