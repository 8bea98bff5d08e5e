"""Array kernels over text: one pass of NumPy per batch instead of one Python call per word.

Texts are joined into one code-point array. Word and token limits, word hashes and word runs are then found for
the whole batch at once, so that Python's cost is per batch and not per word.
"""

from __future__ import annotations

import unicodedata

import numpy as np

LETTER, NUMBER, SPACE = 1, 2, 4

# Unicode White_Space (fixed values of the Unicode Character Database).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def char_classes() -> np.ndarray:
    """Per code point: LETTER, NUMBER, SPACE flags; 0 for all else. Built once a process."""
    if "classes" not in _tables:
        table = np.zeros(0x110000, np.uint8)
        category = unicodedata.category
        for lo, hi in ((0, 0x3FFFF), (0xE0000, 0xE01FF)):  # no letters or numbers are assigned elsewhere
            majors = "".join([category(chr(c))[0] for c in range(lo, hi + 1)])
            codes = np.frombuffer(majors.encode("latin-1"), np.uint8)
            table[lo : hi + 1] |= np.where(codes == ord("L"), LETTER, 0).astype(np.uint8)
            table[lo : hi + 1] |= np.where(codes == ord("N"), NUMBER, 0).astype(np.uint8)
        table[WHITE_SPACE] = SPACE
        _tables["classes"] = table
    return _tables["classes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0 .. n-1, modulo 2**64."""
    if "powers" not in _tables or len(_tables["powers"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("powers", _BASE), ("inverses", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["powers"][:n], _tables["inverses"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def join_texts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by a line feed, as a string and as code points, and where each text starts (one more at the end)."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=starts[1:])
    return joined, points, starts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each unbroken run of True."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(mask.view(np.int8))) + 1
    if mask[0]:
        edges = np.concatenate(([0], edges))
    if mask[-1]:
        edges = np.concatenate((edges, [len(mask)]))
    return edges[::2], edges[1::2]


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each span; equal contents give equal hashes wherever they stand."""
    powers, inverses = _powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[: len(points)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts already lower-cased: the hash of each run of letters and digits, and how many each text has."""
    _, points, text_starts = join_texts(texts)
    starts, ends = runs((char_classes()[points] & (LETTER | NUMBER)) > 0)
    counts = np.diff(np.searchsorted(starts, text_starts))
    return span_hashes(points, starts, ends), counts


def shingle_sets(texts: list[str], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words (of the lower-cased text), and its word count."""
    hashes, counts = words([t.lower() for t in texts])
    limits = np.concatenate(([0], np.cumsum(counts)))
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):  # order matters, so every place has its own odd multiplier
        total += mix(hashes[k : len(total) + k] + np.uint64(k + 1)) * np.uint64(0x9FB21C651E98DF25 + 2 * k)
    total = mix(total)
    return [np.unique(total[a : max(a, b - width + 1)]) for a, b in zip(limits[:-1], limits[1:], strict=True)], counts
