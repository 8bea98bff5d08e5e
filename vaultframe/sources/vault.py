"""A directory of Markdown files as a DataFrame, and what of it is no document."""

from __future__ import annotations

import hashlib
import os
import re
import stat
import time
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder where writers keep their unfinished files: never documents.
MECHANISM = ".vaultframe/tmp"


def is_markdown(path: Column) -> Column:
    """The extension is md, in any ASCII case. A name that is nothing but `.md` has no extension."""
    return path.rlike(r"(?i)[^/]\.md$")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length, modified): every Markdown file under root, path relative to it, read by the executors."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(base)
    local = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^file:(//)?", "")
    return raw.select(F.substr(local, F.lit(len(base) + 2)).alias("path"), "content", "length", F.col("modificationTime").alias("modified"))


def excluded(path: Column, roots: list[str]) -> Column:
    """Whether a path is an excluded root or under one, or under the mechanism's own folder; aligned to segments."""
    out = F.lit(False)
    for r in [*roots, MECHANISM]:
        out = out | (path == r) | path.startswith(r + "/")
    return out


def documents(raw: DataFrame, exclusions: list[str] | None = None) -> DataFrame:
    """(path, content_hash, byte_length, text, refusal): UTF-8 text and SHA-256 of each file that isn't excluded. A file that isn't UTF-8
    has a null text and the refusal 'not-utf8': it keeps its row, so that it can be reported."""
    kept = raw.filter(is_markdown(F.col("path")) & ~excluded(F.col("path"), exclusions or []))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return kept.select(
        "path", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("bigint").alias("byte_length"),
        F.when(valid, F.col("content").cast("string")).alias("text"), F.when(~valid, F.lit("not-utf8")).alias("refusal"),
    )


#: Names of files that a writer has not finished: `.<name>.shadow-<digits>`.
_SHADOW = re.compile(r"\..*\.shadow-[0-9]+$")


def path_kind(at: str) -> str:
    """'regular-file', 'directory', 'missing' or 'other', without following a link at the path itself."""
    try:
        mode = os.lstat(at).st_mode
    except (FileNotFoundError, NotADirectoryError):
        return "missing"
    return "regular-file" if stat.S_ISREG(mode) else "directory" if stat.S_ISDIR(mode) else "other"


def _link_kind(at: str, root: str) -> str:
    """What a symbolic link names: a file or directory of the vault, something outside of it, or nothing."""
    there = os.path.realpath(at)
    if not os.path.exists(there):
        return "dangling"
    base = os.path.realpath(root)
    if there != base and not there.startswith(base + os.sep):
        return "outbound"
    return "in-vault-directory" if os.path.isdir(there) else "in-vault-file"


def _fact(root: str, path: str, name: str, exclusions: list[str]) -> tuple[str | None, str | None, bool]:
    """(skip reason, detail, whether it is a folder to go into) of one place."""
    if any(path == r or path.startswith(r + "/") for r in exclusions):
        return "exclusion", None, False
    if path == MECHANISM or path.startswith(MECHANISM + "/"):
        return "mechanism", None, False
    if _SHADOW.match(name):
        return "shadow", None, False
    at = os.path.join(root, path)
    try:
        mode = os.lstat(at).st_mode
    except FileNotFoundError:
        return "vanished", None, False
    if stat.S_ISLNK(mode):
        return "symbolic-link", _link_kind(at, root), False
    if stat.S_ISDIR(mode):
        return None, None, True
    if not stat.S_ISREG(mode):
        kinds = ((stat.S_ISFIFO, "fifo"), (stat.S_ISSOCK, "socket"), (stat.S_ISBLK, "block-device"), (stat.S_ISCHR, "character-device"))
        return "special-file", next((n for test, n in kinds if test(mode)), "other"), False
    return (None, None, False) if name[-3:].lower() == ".md" and len(name) > 3 else ("not-markdown", None, False)


def _listed(root: str, folder: str, exclusions: list[str], deep: bool) -> Iterator[tuple[str, str | None, str | None, bool]]:
    """(path, skip reason, detail, is a folder) of a folder's places; with `deep`, of all below it, and no folders."""
    todo = [folder]
    while todo:
        here = todo.pop()
        try:
            names = os.listdir(os.path.join(root, here))
        except FileNotFoundError:
            yield here, "vanished", None, False
            continue
        for name in names:
            path = f"{here}/{name}" if here else name
            reason, detail, inside = _fact(root, path, name, exclusions)
            if inside and deep:
                todo.append(path)
            else:
                yield path, reason, detail, inside


#: Folders that a walk wants before it spreads them over the executors.
SPREAD_FOLDERS = 256


def walk_facts(spark: SparkSession, root: str, exclusions: list[str] | None = None, subtree: str = "") -> DataFrame:
    """(path, skip_reason, detail): every place of a tree all executors see, as the walk reports it: a document (null reason) or why it's skipped:
    'exclusion', 'mechanism', 'shadow', 'symbolic-link' (`detail`: what it names), 'special-file' (`detail`: its kind), 'vanished' or
    'not-markdown'. Links are never followed. The driver lists the uppermost folders only, until there are SPREAD_FOLDERS or none; each of
    those is a task's. With `subtree` the walk is of that folder, and paths are still from the root. A folder that may not be read
    is an error, not an absence."""
    skip, top, folders = exclusions or [], [], [subtree.strip("/")]
    if folders[0] and _fact(root, folders[0], os.path.basename(folders[0]), skip)[0]:
        reason, detail, _ = _fact(root, folders[0], os.path.basename(folders[0]), skip)
        return spark.createDataFrame([(folders[0], reason, detail)], "path string, skip_reason string, detail string")
    while folders and len(folders) < SPREAD_FOLDERS:
        found = [f for folder in folders for f in _listed(root, folder, skip, False)]
        top += [f[:3] for f in found if not f[3]]
        folders = [f[0] for f in found if f[3]]
    schema = "path string, skip_reason string, detail string"

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = iter(_listed(root, folder, skip, True))
                while some := [r[:3] for r in islice(rows, 10_000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], names=["path", "skip_reason", "detail"])

    seen = spark.createDataFrame(top, schema)
    if not folders:
        return seen
    return seen.unionByName(spark.createDataFrame([(f,) for f in folders], "path string").repartition(len(folders)).mapInArrow(deeper, schema))


def walk(spark: SparkSession, root: str, exclusions: list[str] | None = None, subtree: str = "") -> DataFrame:
    """(path, skip_reason) of `walk_facts` in path order."""
    return walk_facts(spark, root, exclusions, subtree).select("path", "skip_reason").orderBy("path")


class WriteRefused(Exception):
    """The file isn't what the caller said it was."""


def _hash(at: str) -> str | None:
    try:
        with open(at, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()
    except FileNotFoundError:
        return None


def write_document(root: str, path: str, content: bytes, expected: str | None) -> str:
    """Writes a document whole or not at all, if its file still has the hash `expected` (null: no file), and returns the new hash. The content
    goes to a shadow beside it, is read back, and takes the name in one step."""
    at = os.path.join(root, path)
    if _hash(at) != expected:
        raise WriteRefused("the file has changed")
    os.makedirs(os.path.dirname(at), exist_ok=True)
    shadow = os.path.join(os.path.dirname(at), f".{os.path.basename(at)}.shadow-{os.getpid()}{time.monotonic_ns()}")
    try:
        with open(shadow, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        now = hashlib.sha256(content).hexdigest()
        if _hash(shadow) != now:
            raise WriteRefused("the shadow doesn't read back")
        if _hash(at) != expected:
            raise WriteRefused("the file has changed")
        os.replace(shadow, at)
        return now
    finally:
        if os.path.exists(shadow):
            os.unlink(shadow)


def vacate_document(root: str, path: str, expected: str) -> None:
    """Removes a document's file if it still has the hash `expected`."""
    at = os.path.join(root, path)
    if _hash(at) != expected:
        raise WriteRefused("the file has changed")
    os.unlink(at)


def move_document(root: str, path: str, to: str, expected: str) -> None:
    """Moves a document's file if it still has the hash `expected` and nothing stands at its new place."""
    at, there = os.path.join(root, path), os.path.join(root, to)
    if _hash(at) != expected:
        raise WriteRefused("the file has changed")
    os.makedirs(os.path.dirname(there), exist_ok=True)
    try:
        os.link(at, there)  # fails if the place is taken, where a rename would replace
    except FileExistsError:
        raise WriteRefused("something stands at the new place") from None
    os.unlink(at)
