"""Keeping a store current: watched trees, dirty roots coalesced, micro-batches applied as changesets, a resumable feed as a source."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from vaultframe.operators.store import Store, heal_changes

MOST_ROOTS = 8192


def coalesce_roots(roots: DataFrame, most: int = MOST_ROOTS) -> DataFrame:
    """(root, gone): dirty roots without those under another one, unless they were reported gone. More than `most` become one rescan
    of the whole vault (the root ''): uncertainty widens, it's never dropped. Each root meets its ancestors by an equi-join."""
    merged = roots.groupBy("root").agg(F.max("gone").alias("gone"))
    segs = F.split("root", "/")
    above = merged.filter("not gone").select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(segs) - 1), lambda n: F.concat_ws("/", F.slice(segs, 1, n)))).alias("ancestor")).filter("ancestor <> root")
    covered = above.join(merged.select(F.col("root").alias("ancestor")), "ancestor", "left_semi").select("root").distinct()
    kept = merged.join(covered, "root", "left_anti")
    if kept.limit(most + 1).count() > most:
        return roots.sparkSession.createDataFrame([("", False)], "root string, gone boolean")
    return kept


def late_events(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Events (path, generation, content_hash) with `stale`: they carry what a death of the same or a later generation already buried."""
    dead = tombstones.select("path", F.col("generation").alias("died"), F.col("last_content_hash").alias("buried"))
    stale = F.coalesce((F.col("died") >= F.col("generation")) & F.col("buried").eqNullSafe(F.col("content_hash")), F.lit(False))
    return events.join(dead, "path", "left").withColumn("stale", stale).drop("died", "buried")


def apply_stream(changes: DataFrame, store: Store, checkpoint: str, clock=lambda batch: batch, **trigger) -> StreamingQuery:
    """A stream of changes into a store: one micro-batch is one changeset, one generation. The store's state has the batch's name, so one
    that is replayed after a failure takes no second generation."""

    def batch(df: DataFrame, number: int) -> None:
        store.apply(df, clock(number), batch=f"{checkpoint}#{number}")

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _json(base: str, name: str) -> dict:
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base)
    with system.open_input_stream(f"{at}/{name}") as f:
        return json.loads(f.read())


class _Bucket(InputPartition):
    """One bucket's documents and tombstones of a snapshot, from after a position."""

    def __init__(self, files: list[tuple[str, str]], after: tuple[int, str]) -> None:
        self.files, self.after = files, after


def _positions(files: list[tuple[str, str]], after: tuple[int, str]) -> Iterator[tuple]:
    """(generation, path, kind, content_hash) past a position in the order of the feed; Parquet's bounds skip row groups that are all older. A
    document outranks a death at one position, and both stand in one bucket."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    rows = []
    for kind, at in files:
        system, path = fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)
        names = ["generation", "path", "content_hash" if kind == "document" else "last_content_hash"]
        found = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=names, filter=ds.field("generation") >= after[0])
        rows += [(g, p, kind == "death", kind, h) for g, p, h in zip(*(found[n].to_pylist() for n in names)) if (g, p) > after]
    last = None
    for g, p, _, kind, h in sorted(rows, key=lambda r: r[:3]):
        if (g, p) != last:
            yield g, p, kind, h
        last = (g, p)


class FeedStream(DataSourceStreamReader):
    """The feed as a partitioned source. Offset: {epoch, generation}, a generation whole. A micro-batch reads the pointer of its end's
    generation, so a replay reads the rows that stood then; only buckets written since the start are read, each by a task. An offset
    of another epoch starts the feed anew."""

    def __init__(self, base: str) -> None:
        self.base = base

    def initialOffset(self) -> dict:
        return {"epoch": _json(self.base, "CURRENT.json")["epoch"], "generation": 0}

    def latestOffset(self) -> dict:
        state = _json(self.base, "CURRENT.json")
        return {"epoch": state["epoch"], "generation": state["generation"]}

    def partitions(self, start: dict, end: dict) -> list[_Bucket]:
        after = start["generation"] if start["epoch"] == end["epoch"] else 0
        state = _json(self.base, f"{end['epoch']}/pointer-{end['generation']}.json")
        files: dict[str, list] = {}
        for name, kind in (("documents", "document"), ("tombstones", "death")):
            for b, (revision, generation) in state["written"].get(name, {}).items():
                if generation > after:
                    files.setdefault(b, []).append((kind, f"{self.base}/{end['epoch']}/{name}/rev-{revision}/bucket={b}"))
        return [_Bucket(f, (after + 1, "")) for f in files.values()]

    def read(self, partition: _Bucket) -> Iterator[tuple]:
        return _positions(partition.files, partition.after)


class FeedReader(SimpleDataSourceStreamReader):
    """The feed by pages of few rows, for a consumer that steps through it by hand. Offset: {epoch, generation, path}. A cursor is good within
    one epoch; another epoch starts the feed anew. Reads the buckets written since the cursor's generation."""

    def __init__(self, base: str, page: int) -> None:
        self.base, self.page = base, page

    def _rows(self, state: dict, after: tuple[int, str], most: int | None) -> list[tuple]:
        found: list[tuple] = []
        for part in FeedStream(self.base).partitions({"epoch": state["epoch"], "generation": max(0, after[0] - 1)}, state):
            found = heapq.nsmallest(most, [*found, *_positions(part.files, after)]) if most else [*found, *_positions(part.files, after)]
        return sorted(found)

    def initialOffset(self) -> dict:
        return {"epoch": _json(self.base, "CURRENT.json")["epoch"], "generation": 0, "path": ""}

    def read(self, start: dict):
        state = _json(self.base, "CURRENT.json")
        after = (start["generation"], start["path"]) if state["epoch"] == start["epoch"] else (0, "")
        rows = [r for r in self._rows(state, (after[0], after[1]), self.page)]
        end = {"epoch": state["epoch"], "generation": rows[-1][0], "path": rows[-1][1]} if rows else start
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        state = _json(self.base, f"{end['epoch']}/pointer-{end['generation']}.json")
        after = (start["generation"], start["path"]) if start["epoch"] == end["epoch"] else (0, "")
        return iter([r for r in self._rows(state, after, None) if (r[0], r[1]) <= (end["generation"], end["path"])])

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """spark.readStream.format("vault_feed").option("path", base): a store's change feed, read by the executors."""

    @classmethod
    def name(cls) -> str:
        return "vault_feed"

    def schema(self) -> str:
        return "generation bigint, path string, kind string, content_hash string"

    def streamReader(self, schema):
        return FeedStream(self.options["path"].removeprefix("file://").rstrip("/"))


class TreeReader(SimpleDataSourceStreamReader):
    """A tree watched by comparing listings. Offset: {number}, a listing kept under `state`. A batch has the folders in which a Markdown file came,
    went or changed, as dirty roots; the first has the whole vault. A listing that can't be had widens to the whole vault: uncertainty
    is never dropped."""

    def __init__(self, root: str, state: str) -> None:
        self.root, self.state = root.rstrip("/"), state.rstrip("/")

    def _list(self) -> dict[str, list]:
        out: dict[str, list] = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                if name.lower().endswith(".md") and len(name) > 3:
                    try:
                        s = os.stat(os.path.join(folder, name))
                    except FileNotFoundError:
                        continue
                    rel = os.path.relpath(folder, self.root)
                    out[name if rel == "." else f"{rel}/{name}"] = [s.st_mtime_ns, s.st_size]
        return out

    def _kept(self, number: int) -> dict | None:
        try:
            with open(f"{self.state}/{number}.json") as f:
                return json.load(f)
        except (FileNotFoundError, ValueError):
            return None

    def initialOffset(self) -> dict:
        return {"number": 0}

    def read(self, start: dict):
        now, old = self._list(), self._kept(start["number"]) if start["number"] else None
        if old == now:
            return iter([]), start
        os.makedirs(self.state, exist_ok=True)
        end = {"number": start["number"] + 1}
        with open(f"{self.state}/.{end['number']}", "w") as f:
            json.dump(now, f)
        os.replace(f"{self.state}/.{end['number']}", f"{self.state}/{end['number']}.json")
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict):
        old, now = self._kept(start["number"]), self._kept(end["number"])
        if old is None or now is None:
            return iter([("", False, True)])
        dirty = {os.path.dirname(p) for p in old.keys() | now.keys() if old.get(p) != now.get(p)}
        folders = {os.path.dirname(p) for p in now}
        return iter([(d, not any(f == d or f.startswith(d + "/") for f in folders), False) for d in sorted(dirty)])


class TreeSource(DataSource):
    """spark.readStream.format("vault_tree").option("path", root).option("state", folder): (root, gone, rescan) of a watched tree."""

    @classmethod
    def name(cls) -> str:
        return "vault_tree"

    def schema(self) -> str:
        return "root string, gone boolean, rescan boolean"

    def simpleStreamReader(self, schema):
        return TreeReader(self.options["path"], self.options["state"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSource)
    spark.dataSource.register(TreeSource)


#: How long a batch of dirty roots may wait for more of them.
SETTLE = "500 milliseconds"


def merge_batches(batches: DataFrame, most: int = MOST_ROOTS) -> DataFrame:
    """(root, gone, rescan) of several batches as one: their roots coalesced, and one rescan of the whole vault if any asked for it. A root
    that was reported gone stays its own."""
    if not batches.filter("rescan").isEmpty():
        return batches.sparkSession.createDataFrame([("", False, True)], "root string, gone boolean, rescan boolean")
    kept = coalesce_roots(batches.select("root", "gone"), most)
    return kept.select("root", "gone", (F.col("root") == "").alias("rescan"))


def increment_stream(roots: DataFrame, walk, store: Store, checkpoint: str, clock=lambda batch: batch, **trigger) -> StreamingQuery:
    """A stream of dirty roots into a store, at most a batch each SETTLE: what `walk()` finds on disk under them (columns of DOCUMENT and, if it
    likes, the fact arrays) against what the store holds there. Files outside the roots aren't compared."""

    def batch(df: DataFrame, number: int) -> None:
        merged = merge_batches(df)
        store.apply(scoped_changes(merged, walk(), store.read("documents")), clock(number), batch=f"{checkpoint}#{number}")

    return roots.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": SETTLE})).start()


def scoped_changes(roots: DataFrame, disk: DataFrame, documents: DataFrame) -> DataFrame:
    """The changeset of dirty roots: files under a root that are new or changed, and deaths of rows under one that no file accounts for. Each path
    meets its own ancestors by an equi-join; the root '' has all."""
    segs = F.split("path", "/")
    above = F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.concat_ws("/", F.slice(segs, 1, n))))).alias("root")

    def inside(df: DataFrame) -> DataFrame:
        return df.join(df.select("path", above).join(roots.select("root").distinct(), "root", "left_semi").select("path").distinct(), "path", "left_semi")

    return heal_changes(inside(disk), inside(documents))
