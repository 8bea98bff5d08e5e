"""The derived store: documents, their facts, tombstones, findings and postings as Parquet behind a pointer; changesets applied atomically.

A change has (seq, path, kind) with kind 'upsert' or 'death', for upserts the document's columns, and if the changes have them the arrays
`headings`, `links`, `tags` and `blocks` of the parse pass. The last entry of a path wins. An empty changeset takes no generation.

Every table is cut into buckets by its path's hash. A changeset writes the buckets its paths are in and no other, whatever the store's size;
the pointer says for each bucket which revision is current. Files are whole before the pointer moves, so a reader sees one generation,
and the pointers of past generations stay until `vacuum`, so that a replay reads what it read before.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.functions import parse
from vaultframe.operators import findings, fulltext, paths
from vaultframe.session import materialize

DOCUMENT = ["path", "content_hash", "byte_length", "body", "body_hash", "body_offset", "frontmatter", "frontmatter_projection_hash", "frontmatter_diagnostic_count"]
DOCUMENTS = "path string, content_hash string, byte_length bigint, body string, body_hash string, body_offset bigint, frontmatter string, frontmatter_projection_hash string, frontmatter_diagnostic_count int, suffix_key string, generation bigint, derived_at bigint"
TOMBSTONES = "path string, last_content_hash string, provenance string, generation bigint, recorded_at bigint"
FACTS = {"headings": parse.HEADING, "links": parse.LINK, "tags": parse.TAG, "blocks": parse.BLOCK}
SCHEMAS = {
    "documents": DOCUMENTS,
    "tombstones": TOMBSTONES,
    "findings": findings.RECORD,
    "postings": "term string, path string, positions array<int>",
    "vectors": "path string, model_id string, model_version string, content_hash string, dimensions int, embedding array<float>, generation bigint",
    **{name: "path string, " + fields.replace(":", " ").replace(",", ", ") for name, fields in FACTS.items()},
}
# What a request counts: fixed names. A request that only reads leaves all at zero.
COUNTERS = [
    "documents_upserted", "documents_deleted", "link_rows_written", "heading_rows_written", "block_rows_written", "tag_rows_written", "fact_rows_discarded",
    "frontmatter_projections", "tombstones_recorded", "findings_written", "findings_discarded", "vectors_written", "vault_schema_pins",
]
PROVENANCES = ["heal-prune", "watcher-removal", "plan-delete", "quarantine"]


def fold(changes: DataFrame) -> DataFrame:
    """The last entry of each path. Partial maxima before the one shuffle."""
    rest = [c for c in changes.columns if c != "path"]
    last = changes.groupBy("path").agg(F.max_by(F.struct(*rest), "seq").alias("c"))
    return last.select("path", *[F.col(f"c.{c}").alias(c) for c in rest])


def refused(changes: DataFrame) -> DataFrame:
    """Upserts whose body doesn't fill the file from its offset on, or whose path is no vault path."""
    up = changes.filter("kind = 'upsert'")
    size = F.col("body_offset") + F.octet_length("body") != F.col("byte_length")
    return up.select("path", F.coalesce(paths.refusal(F.col("path")), F.when(size, "size")).alias("reason")).filter("reason is not null")


def upserted(folded: DataFrame, generation: int, at: int) -> DataFrame:
    up = folded.filter("kind = 'upsert'").select(*DOCUMENT)
    return up.withColumns({"suffix_key": paths.suffix_key(F.col("path")), "generation": F.lit(generation).cast("bigint"), "derived_at": F.lit(at).cast("bigint")})


def next_documents(documents: DataFrame, folded: DataFrame, generation: int, at: int) -> DataFrame:
    return documents.join(folded.select("path"), "path", "left_anti").unionByName(upserted(folded, generation, at))


def next_tombstones(tombstones: DataFrame, documents: DataFrame, folded: DataFrame, generation: int, at: int) -> DataFrame:
    """A death records the new hash if it has one, else the row's, else the one recorded before; a path never derived is still recorded.
    A path that is written again keeps its tombstone."""
    dead = folded.filter("kind = 'death'").select("path", F.col("content_hash").alias("given"), "provenance")
    known = documents.select("path", F.col("content_hash").alias("held"))
    before = tombstones.select("path", F.col("last_content_hash").alias("recorded"))
    new = dead.join(known, "path", "left").join(before, "path", "left").select(
        "path", F.coalesce("given", "held", "recorded").alias("last_content_hash"), "provenance", F.lit(generation).cast("bigint").alias("generation"), F.lit(at).cast("bigint").alias("recorded_at")
    )
    return tombstones.join(dead.select("path"), "path", "left_anti").unionByName(new)


def verify(documents: DataFrame, links: DataFrame, headings: DataFrame, tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """(check, offenders): recomputed hashes and sizes, orphan facts, closed vocabularies, JSON. One scan a table, one row a check."""

    def count(df: DataFrame, checks: dict) -> list[DataFrame]:
        row = df.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(n) for n, c in checks.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("offenders")) for n in checks])
        return [row.select(F.explode(pairs).alias("p")).select("p.*")]

    docs = documents.filter("body is not null")
    parts = count(
        docs,
        {
            "body_hash": F.sha2("body", 256) != F.col("body_hash"),
            "size": F.col("body_offset") + F.octet_length("body") != F.col("byte_length"),
            "suffix_key": paths.suffix_key(F.col("path")) != F.col("suffix_key"),
            "frontmatter_json": F.col("frontmatter").isNotNull() & F.try_parse_json("frontmatter").isNull(),
            "projection_hash": ~F.sha2("frontmatter", 256).eqNullSafe(F.col("frontmatter_projection_hash")),
        },
    )
    parts += count(links, {"link_family": ~F.col("family").isin("wikilink", "markdown")})
    parts += count(headings, {"heading_level": ~F.col("level").between(1, 6)})
    parts += count(tags, {"tag_source": ~F.col("source").isin("body", "frontmatter")})
    ids = documents.select(F.col(key).alias("document"))
    for name, facts in (("orphan_links", links), ("orphan_headings", headings), ("orphan_tags", tags)):
        parts.append(facts.join(ids, "document", "left_anti").agg(F.count(F.lit(1)).alias("offenders")).select(F.lit(name).alias("check"), "offenders"))
    return reduce(DataFrame.unionByName, parts)


#: What a failure says when stored files are damaged or gone, and when it is about rights: only the first is a reason to derive anew.
_DAMAGED = ["is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "PATH_NOT_FOUND", "FileNotFoundException", "Could not read footer", "corrupt"]
_DENIED = ["Permission denied", "AccessControlException", "AccessDenied", "Forbidden"]


class Store:
    """`base/<epoch>/<table>/rev-<n>/bucket=<b>` behind `base/CURRENT.json`; a past generation's pointer is `base/<epoch>/pointer-<generation>.json`.
    One writer; the pointer's replacement is the commit. `buckets` is fixed when the store is made: about its expected size over what
    one task writes well (some hundred MB). With `indexed` the postings of bodies are kept too."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 8, indexed: bool = False) -> None:
        self.spark, self.base, self.counters = spark, base.rstrip("/"), dict.fromkeys(COUNTERS, 0)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not self._fs.exists(self._path(f"{self.base}/CURRENT.json")):
            self._point(self._fresh({"schema": None, "buckets": buckets, "indexed": indexed}))

    @staticmethod
    def _fresh(kept: dict) -> dict:
        return {**kept, "epoch": uuid.uuid4().hex, "generation": 0, "revision": 0, "batch": None, "written": {}}

    def _write(self, name: str, state: dict) -> None:
        """One small file, whole or not at all."""
        new, now = self._path(f"{self.base}/.next-{uuid.uuid4().hex}"), self._path(name)
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._fs.mkdirs(now.getParent())
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(now.toUri() if now.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(new), self._fs.makeQualified(now), overwrite)

    def _point(self, state: dict) -> None:
        self._write(f"{self.base}/{state['epoch']}/pointer-{state['generation']}.json", state)
        self._write(f"{self.base}/CURRENT.json", state)

    def state(self) -> dict:
        stream = self._fs.open(self._path(f"{self.base}/CURRENT.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def open(self, fingerprint: str) -> str:
        """'created', 'opened' or 'rebuilt': a store made by other code, or one whose files are damaged or gone, is discarded for a new epoch,
        whose cursors start anew. A read that fails for want of rights, or for any other reason, is raised: it is no evidence of damage."""
        state = self.state()
        made = state.get("made_by")
        if made == fingerprint:
            try:
                for name in state["written"]:
                    self.read(name).limit(1).collect()
                return "opened"
            except (PySparkException, Py4JJavaError) as e:
                said = str(e)
                if any(x in said for x in _DENIED) or not any(x in said for x in _DAMAGED):
                    raise
        kept = {k: state[k] for k in ("schema", "buckets", "indexed")}
        self._point({**self._fresh(kept), "made_by": fingerprint})
        return "created" if made is None and not state["generation"] else "rebuilt"

    def _bucket(self, state: dict):
        return F.pmod(F.xxhash64("path"), F.lit(state["buckets"])).cast("int").alias("bucket")

    def _at(self, state: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        there = {int(b): r for b, r in state["written"].get(name, {}).items() if buckets is None or int(b) in buckets}
        if not there:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.base}/{state['epoch']}/{name}/rev-{r[0]}/bucket={b}" for b, r in sorted(there.items())])

    def read(self, name: str) -> DataFrame:
        """One of SCHEMAS' tables as it stands."""
        return self._at(self.state(), name)

    def _put(self, state: dict, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """Writes the buckets anew, sorted so that a reader's bounds skip row groups, and says so in `state`."""
        to = f"{self.base}/{state['epoch']}/{name}/rev-{state['revision']}"
        order = ["bucket", "term", "path"] if name == "postings" else ["bucket", "path", "ordinal"] if name in FACTS else ["bucket", "path"]
        placed = rows.select("*", self._bucket(state))
        placed.repartition(max(1, len(buckets)), "bucket").sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(to)
        full = {int(f.getPath().getName().split("=")[1]) for f in self._fs.listStatus(self._path(to)) if f.isDirectory()}
        now = state["written"].setdefault(name, {})
        for b in buckets:
            now.pop(str(b), None)
            if b in full:
                now[str(b)] = [state["revision"], state["generation"]]

    def _buckets_of(self, state: dict, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket(state)).distinct().collect())

    def apply(self, changes: DataFrame, at: int, batch: str | None = None) -> int:
        """Applies a changeset and returns the generation it took, or the current one if it was empty. A changeset with a refused entry
        changes nothing. Findings of the changed paths, and link findings of the classes they touch, are discarded with it. A `batch`
        that the last changeset was applied under is not applied again, so a batch replayed after a crash changes nothing."""
        state, self.counters = self.state(), dict.fromkeys(COUNTERS, 0)
        if batch is not None and state["batch"] == batch:
            return state["generation"]
        folded = materialize(fold(changes), "changes")
        bad = refused(folded).limit(5).collect()
        if bad:
            raise ValueError(f"changeset refused: {[tuple(r) for r in bad]}")
        touched = self._buckets_of(state, folded)
        if not touched:
            return state["generation"]
        new = {**state, "generation": state["generation"] + 1, "revision": state["revision"] + 1, "batch": batch, "written": {k: dict(v) for k, v in state["written"].items()}}
        documents, tombstones = self._at(state, "documents", touched), self._at(state, "tombstones", touched)
        paths_ = folded.select("path")
        self._count(state, folded, documents, touched)
        if state["indexed"]:
            up = folded.filter("kind = 'upsert'").select("path", "body", "body_hash")
            same = up.join(documents.select("path", "body_hash"), ["path", "body_hash"], "left_semi").select("path")
            moved = paths_.join(same, "path", "left_anti")  # a body that is what it was keeps its postings
            fresh = fulltext.postings(up.join(moved, "path", "left_semi"), "path", "body").select("term", F.col("doc").alias("path"), "positions")
            self._put(new, "postings", self._at(state, "postings", touched).join(moved, "path", "left_anti").unionByName(fresh), touched)
        self._put(new, "documents", next_documents(documents, folded, new["generation"], at), touched)
        self._put(new, "tombstones", next_tombstones(tombstones, documents, folded, new["generation"], at), touched)
        for name in FACTS:
            if name in folded.columns or name in state["written"]:
                old = self._at(state, name, touched).join(paths_, "path", "left_anti")
                facts = folded.filter("kind = 'upsert'").select("path", F.explode(name).alias("f")).select("path", "f.*") if name in folded.columns else None
                self._put(new, name, old if facts is None else old.unionByName(facts), touched)
        if "findings" in state["written"]:
            standing = self._at(state, "findings")
            classes = findings.affected_classes(folded)
            hit = standing.select("id", "path", F.explode("class_keys").alias("k")).select("id", "path", F.concat(F.substring_index("k", "/", 1), F.lit("/")).alias("class_key")).join(classes, "class_key", "left_semi")
            hit = materialize(hit.select("id", "path").distinct(), "discarded")
            also = sorted({*touched, *self._buckets_of(state, hit)})
            self.counters["findings_discarded"] = standing.select("id", "path").join(paths_, "path", "left_semi").union(hit).distinct().count()
            self._put(new, "findings", self._at(state, "findings", also).join(paths_, "path", "left_anti").join(hit, ["id", "path"], "left_anti"), also)
        if "vectors" in state["written"]:
            dead = folded.filter("kind = 'death'").select("path")
            self._put(new, "vectors", self._at(state, "vectors", touched).join(dead, "path", "left_anti"), touched)
        self._point(new)
        return new["generation"]

    def _count(self, state: dict, folded: DataFrame, documents: DataFrame, touched: list[int]) -> None:
        """What a changeset is about to write and drop: one pass over it, and one for each table of facts that it touches."""
        up = F.col("kind") == "upsert"
        number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        facts = {"links": "link_rows_written", "headings": "heading_rows_written", "blocks": "block_rows_written", "tags": "tag_rows_written"}
        sums = {"documents_upserted": up.cast("int"), "tombstones_recorded": (~up).cast("int"), "frontmatter_projections": (up & F.col("frontmatter").isNotNull()).cast("int")}
        sums |= {name: F.when(up, F.size(table)) for table, name in facts.items() if table in folded.columns}
        self.counters |= folded.agg(*[number(c).alias(n) for n, c in sums.items()]).first().asDict()
        self.counters["documents_deleted"] = documents.select("path").join(folded.filter(~up).select("path"), "path", "left_semi").count()
        self.counters["fact_rows_discarded"] = sum(self._at(state, t, touched).join(folded.select("path"), "path", "left_semi").count() for t in FACTS if t in state["written"])

    def store_vectors(self, rows: DataFrame) -> None:
        """Keeps vectors (path, model_id, model_version, content_hash, dimensions, embedding): one for each path, model and version, the new ones
        instead of the old, under the current generation. A vector of a path that has no document refuses all. A death takes its path's along."""
        state, self.counters = self.state(), dict.fromkeys(COUNTERS, 0)
        keys = ["path", "model_id", "model_version"]
        fresh = materialize(rows.select(*keys, "content_hash", "dimensions", "embedding").dropDuplicates(keys).withColumn("generation", F.lit(state["generation"]).cast("bigint")), "vectors")
        touched = self._buckets_of(state, fresh)
        unknown = fresh.select("path").join(self._at(state, "documents", touched).select("path"), "path", "left_anti").limit(5).collect()
        if unknown:
            raise ValueError(f"vectors of unknown documents: {[r['path'] for r in unknown]}")
        if touched:
            new = {**state, "revision": state["revision"] + 1, "written": {k: dict(v) for k, v in state["written"].items()}}
            self._put(new, "vectors", self._at(state, "vectors", touched).join(fresh.select(*keys), keys, "left_anti").unionByName(fresh), touched)
            self._point(new)
        self.counters["vectors_written"] = fresh.count()

    def record(self, found: DataFrame) -> int:
        """Adds findings (`findings.records`) under the pinned schema's fingerprint and the current generation, and returns how many stand now.
        One with a head of more than HEAD candidates, or of more than there are, refuses all. A finding of a place is withheld while a
        document stands there; a finding that stands already is one row."""
        state, self.counters = self.state(), dict.fromkeys(COUNTERS, 0)
        rows = materialize(found.select(*[c for c in found.columns if c not in ("fingerprint", "generation")]), "found")
        bad = rows.filter((F.size("candidates") > findings.resolve.HEAD) | (F.size("candidates") > F.col("candidates_total"))).limit(5).collect()
        if bad:
            raise ValueError(f"findings refused: {[(r['kind'], r['path']) for r in bad]}")
        touched = self._buckets_of(state, rows)
        new = {**state, "revision": state["revision"] + 1, "written": {k: dict(v) for k, v in state["written"].items()}}
        if touched:
            fresh = findings.withheld(rows, self._at(state, "documents", touched)).withColumns({"fingerprint": F.lit(state["schema"]).cast("string"), "generation": F.lit(state["generation"]).cast("bigint")})
            old = self._at(state, "findings", touched)
            added = materialize(fresh.join(old, ["id", "path"], "left_anti"), "added")
            self.counters["findings_written"] = added.count()
            self._put(new, "findings", old.unionByName(added), touched)
            self._point(new)
        return self.read("findings").count()

    def discard(self, subjects: DataFrame, kinds: list[str] | None = None) -> None:
        """Drops the findings of some paths, all or of some kinds."""
        state = self.state()
        touched = self._buckets_of(state, subjects)
        new = {**state, "revision": state["revision"] + 1, "written": {k: dict(v) for k, v in state["written"].items()}}
        old = self._at(state, "findings", touched)
        chosen = old.filter(F.col("kind").isin(kinds)) if kinds is not None else old
        gone = chosen.join(subjects.select("path"), "path", "left_semi").select("id", "path")
        self._put(new, "findings", old.join(gone, ["id", "path"], "left_anti"), touched)
        self._point(new)

    def pin_schema(self, fingerprint: str) -> bool:
        """Whether the pinned validation schema changed; equal fingerprints are a no-op. A new one takes a generation and drops the findings
        of any other; facts stay."""
        state = self.state()
        if state["schema"] == fingerprint:
            return False
        new = {**state, "schema": fingerprint, "generation": state["generation"] + bool(state["generation"]), "revision": state["revision"] + 1, "written": {k: dict(v) for k, v in state["written"].items()}}
        if "findings" in state["written"]:
            self._put(new, "findings", self.read("findings").filter(F.col("fingerprint") == fingerprint), [int(b) for b in state["written"]["findings"]])
        self.counters = dict.fromkeys(COUNTERS, 0) | {"vault_schema_pins": 1}
        self._point(new)
        return True

    def schema_pin(self) -> DataFrame:
        """(fingerprint, generation): the pinned schema as it stands."""
        state = self.state()
        return self.spark.createDataFrame([(state["schema"], state["generation"])], "fingerprint string, generation bigint")

    def drift(self) -> DataFrame:
        """(side, rows): postings that only the stored index has, or only an index derived from the stored bodies now."""
        derived = fulltext.postings(self.read("documents"), "path", "body").select("term", F.col("doc").alias("path"), "positions")
        return fulltext.drift(self.read("postings"), derived)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes revisions that none of the last `keep` generations' pointers needs, and the pointers before them. How many folders went."""
        state, gone = self.state(), 0
        root = f"{self.base}/{state['epoch']}"
        held = [state]
        for f in list(self._fs.listStatus(self._path(root))):
            name = f.getPath().getName()
            if name.startswith("pointer-"):
                if int(name[8:-5]) > state["generation"] - keep:
                    stream = self._fs.open(f.getPath())
                    held.append(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                    stream.close()
                else:
                    self._fs.delete(f.getPath(), False)
        for name in state["written"]:
            needed = {(r[0], int(b)) for h in held for b, r in h["written"].get(name, {}).items()}
            for rev in list(self._fs.listStatus(self._path(f"{root}/{name}"))):
                n = int(rev.getPath().getName()[4:])
                for b in list(self._fs.listStatus(rev.getPath())):
                    if b.isDirectory() and (n, int(b.getPath().getName().split("=")[1])) not in needed:
                        gone += self._fs.delete(b.getPath(), True)
        return gone


def heal(disk: DataFrame, documents: DataFrame) -> DataFrame:
    """(path, action): full-outer merge of what stands on disk (path, content_hash) with the stored rows: 'derive', 're-derive', 'prune'
    or 'keep'. One shuffle on path; bodies stay out of it."""
    a, b = disk.select("path", F.col("content_hash").alias("now")), documents.select("path", F.col("content_hash").alias("held"))
    state = F.when(F.col("held").isNull(), "derive").when(F.col("now").isNull(), "prune").when(F.col("now") != F.col("held"), "re-derive").otherwise("keep")
    return a.join(b, "path", "full_outer").select("path", state.alias("action"))


def heal_changes(disk: DataFrame, documents: DataFrame) -> DataFrame:
    """The changeset that brings the store to what stands on disk. `disk` has the columns of DOCUMENT, and may have the fact arrays."""
    actions = heal(disk, documents)
    up = disk.join(actions.filter("action in ('derive', 're-derive')").select("path"), "path", "left_semi").select(F.lit(0).alias("seq"), F.lit("upsert").alias("kind"), *DOCUMENT, *[c for c in FACTS if c in disk.columns], F.lit(None).cast("string").alias("provenance"))
    gone = actions.filter("action = 'prune'").select("path", F.lit(1).alias("seq"), F.lit("death").alias("kind"), F.lit("heal-prune").alias("provenance"))
    return up.unionByName(gone, allowMissingColumns=True)
