"""Path and target grammar as Column expressions: all JVM-side, all pushed into the scan's projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The control characters of Unicode, C1 included.
CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def stem(leaf: Column) -> Column:
    """A name without its last extension; a dot at its start begins none (`.gitignore` stays)."""
    return F.regexp_replace(leaf, r"(?s)^(.+)\.[^.]*$", "$1")


def segments(path: Column) -> Column:
    return F.split(path, "/", -1)


def reduced(path: Column) -> Column:
    """The path without its last segment's last extension."""
    return F.regexp_replace(path, r"(?s)^(.*[^/])\.[^./]*$", "$1")


def suffix_key(path: Column) -> Column:
    """Segments reversed, the last one's extension dropped, each followed by '/': docs/a/b.md -> b/a/docs/."""
    segs = F.reverse(segments(path))
    return F.concat(F.concat_ws("/", F.concat(F.array(stem(F.element_at(segs, 1))), F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0))))), F.lit("/"))


def class_key(path: Column) -> Column:
    """`stem/`: the key of the documents that a bare stem could name."""
    return F.concat(stem(F.element_at(segments(path), -1)), F.lit("/"))


def suffixes(path: Column) -> Column:
    """Every suffix of the path's segments, extension dropped: what a wikilink may call it. As many as the path is deep."""
    segs = segments(reduced(path))
    return F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.concat_ws("/", F.slice(segs, -n, n)))


def suffix_forms(target: Column) -> Column:
    """The one or two spellings a suffix target probes: as written, and without its last extension."""
    return F.array_distinct(F.array(target, reduced(target)))


def probe_keys(target: Column) -> Column:
    """The suffix_key prefixes a target probes, one or two, reversed segments each followed by '/'."""
    return F.transform(suffix_forms(target), lambda t: F.concat(F.concat_ws("/", F.reverse(segments(t))), F.lit("/")))


def refusal(path: Column) -> Column:
    """Why a path spelling is refused, or null: the first reason that holds."""
    segs = segments(path)
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.startswith("/"), "absolute")
        .when(path.contains("\\"), "backslash")
        .when(path.rlike(CONTROL), "control")
        .when(F.exists(segs, lambda s: s == ""), "empty-segment")
        .when(F.exists(segs, lambda s: s.isin(".", "..")), "dot-segment")
        .when(stem(F.element_at(segs, -1)).rlike(r"^\.+$"), "dot-stem")
    )


def under(path: Column, root: str, itself: bool) -> Column:
    """Descendants of a folder as a range over bytes ('/' up to '0'), which Parquet prunes by; with `itself`, the root too."""
    inside = (path >= F.lit(root + "/")) & (path < F.lit(root + "0"))
    return inside | (path == root) if itself else inside


def ascii_fold(path: Column) -> Column:
    """A-Z to a-z and nothing else, as a folding vault orders names."""
    return F.translate(path, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normal_refusal(path: Column) -> Column:
    """Why an access path has no normal form, or null: nothing is left of it, it is absolute, or it has a `..`."""
    segs = segments(path)
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.startswith("/"), "absolute")
        .when(F.exists(segs, lambda s: s == ".."), "parent-traversal")
        .when(F.forall(segs, lambda s: s.isin(".", "")), "empty")
    )


def normal(path: Column) -> Column:
    """An access path without `.` segments and doubled separators; null where it is refused. `ascii_fold` of it is its identity in a vault
    that folds case."""
    return F.when(normal_refusal(path).isNull(), F.concat_ws("/", F.filter(segments(path), lambda s: ~s.isin(".", ""))))


def normalize(segs: Column) -> Column:
    """Segments with '.' and empty ones dropped and '..' resolved; null if it climbs above the root."""
    start = F.array().cast("array<string>")
    return F.aggregate(
        segs,
        start,
        lambda acc, s: F.when(acc.isNull() | s.isin(".", ""), acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
        .otherwise(F.concat(acc, F.array(s))),
    )


def relative(folder_of: Column, target: Column) -> Column:
    """The vault path a Markdown target names: from the folder of `folder_of`, or from the root after a leading '/'. Null above the root."""
    segs = segments(folder_of)
    base = F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0)))
    parts = normalize(F.when(target.startswith("/"), segments(F.substring(target, 2, 1 << 30))).otherwise(F.concat(base, segments(target))))
    return F.when(parts.isNotNull(), F.concat_ws("/", parts))


def minimal_suffix_keys(path: Column) -> Column:
    """suffix_key prefixes of rising depth, for counting which is the first to name one document."""
    segs = F.reverse(segments(reduced(path)))
    return F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.concat(F.concat_ws("/", F.slice(segs, 1, n)), F.lit("/")))
