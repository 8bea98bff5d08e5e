"""Store, streaming and plans: rebuild equals increment, last entry wins, feeds drain once, edits are all or nothing."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from vaultframe.functions import parse
from vaultframe.operators import findings, formats, reads, store, vectors
from vaultframe.plans import edits, plans
from vaultframe.sources import vault
from vaultframe.streaming import watch

CHANGE = "seq int, kind string, path string, content_hash string, byte_length bigint, body string, body_hash string, body_offset bigint, frontmatter string, frontmatter_projection_hash string, frontmatter_diagnostic_count int, provenance string"


def up(seq, path, body):
    h = hashlib.sha256(body.encode()).hexdigest()
    return (seq, "upsert", path, h, len(body.encode()), body, h, 0, None, None, 0, None)


def death(seq, path):
    return (seq, "death", path, None, None, None, None, None, None, None, None, "watcher-removal")


def state(s):
    return sorted((r["path"], r["body"]) for r in s.read("documents").select("path", "body").collect())


def test_increments_equal_rebuild(spark, tmp_path):
    rng = random.Random(3)
    s = store.Store(spark, str(tmp_path / "s"))
    model = {}
    for g in range(4):
        changes = []
        for seq in range(12):
            p = f"d/{rng.randrange(6)}.md"
            if rng.random() < 0.3:
                changes.append(death(seq, p))
                model.pop(p, None)
            else:
                body = f"b{rng.randrange(100)}é"
                changes.append(up(seq, p, body))
                model[p] = body
        assert s.apply(spark.createDataFrame(changes, CHANGE), g) == g + 1
    assert state(s) == sorted(model.items())
    whole = store.Store(spark, str(tmp_path / "w"))
    whole.apply(spark.createDataFrame([up(0, p, b) for p, b in model.items()], CHANGE), 9)
    assert state(whole) == state(s) != []
    assert s.apply(spark.createDataFrame([], CHANGE), 5) == 4  # an empty changeset takes no generation
    with pytest.raises(ValueError):
        s.apply(spark.createDataFrame([(0, "upsert", "x.md", "h", 99, "short", "h", 0, None, None, 0, None)], CHANGE), 6)
    assert s.state()["generation"] == 4 and s.pin_schema("f") and not s.pin_schema("f")


def test_heal_converges(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.apply(spark.createDataFrame([up(0, "a.md", "1"), up(1, "b.md", "2"), up(2, "c.md", "3")], CHANGE), 0)
    disk = spark.createDataFrame([up(0, "a.md", "1"), up(1, "b.md", "new"), up(2, "d.md", "4")], CHANGE).select(*store.DOCUMENT)
    assert {r["path"]: r["action"] for r in store.heal(disk, s.read("documents")).collect()} == {"a.md": "keep", "b.md": "re-derive", "c.md": "prune", "d.md": "derive"}
    s.apply(store.heal_changes(disk, s.read("documents")), 1)
    assert state(s) == [("a.md", "1"), ("b.md", "new"), ("d.md", "4")]
    assert [r["provenance"] for r in s.read("tombstones").collect()] == ["heal-prune"]
    assert store.heal_changes(disk, s.read("documents")).count() == 0


def test_stream_and_feed(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "s")
    s = store.Store(spark, base)
    spark.createDataFrame([up(0, "a.md", "1"), up(1, "b.md", "2")], CHANGE).write.parquet(source)
    changes = spark.readStream.schema(CHANGE).parquet(source)
    watch.apply_stream(changes, s, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([death(0, "a.md"), up(1, "c.md", "3")], CHANGE).write.mode("append").parquet(source)
    watch.apply_stream(changes, s, str(tmp_path / "c")).awaitTermination()
    assert state(s) == [("b.md", "2"), ("c.md", "3")] and s.state()["generation"] == 2
    reader = watch.FeedReader(base, page=1)
    at, seen = reader.initialOffset(), []
    while True:
        rows, at = reader.read(at)
        rows = list(rows)
        if not rows:
            break
        seen += rows
    assert [(g, p, k) for g, p, k, _ in seen] == [(1, "b.md", "document"), (2, "a.md", "death"), (2, "c.md", "document")]
    rows, _ = reader.read({**at, "epoch": "another"})
    assert len(list(rows)) == 1  # another epoch begins anew
    watch.register(spark)
    q = spark.readStream.format("vault_feed").option("path", base).load().writeStream.format("memory").queryName("feed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("feed").count() == 3


def parsed(spark, rows, start=0):
    """Upserts with their facts, of (path, text)."""
    docs = parse.parse(spark.createDataFrame(rows, "path string, text string"), "path", "text").join(spark.createDataFrame(rows, "path string, text string"), "path")
    return docs.select(
        F.lit(start).alias("seq"), F.lit("upsert").alias("kind"), "path", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("bigint").alias("byte_length"), "body",
        F.sha2("body", 256).alias("body_hash"), "body_offset", "frontmatter", F.sha2("frontmatter", 256).alias("frontmatter_projection_hash"), "frontmatter_diagnostic_count",
        F.lit(None).cast("string").alias("provenance"), "headings", "links", "tags", "blocks",
    )


def files_of(base):
    return {str(p) for p in base.rglob("*.parquet")}


def test_store_keeps_facts_current(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), buckets=4, indexed=True)
    s.apply(parsed(spark, [("a.md", "# One\n[[b]] #x moss\n"), ("n/b.md", "---\ntags: [y]\n---\n# Two\ntext ^id1\n"), ("c.md", "[[gone]]\n")]), 1)
    facts = lambda name, c: sorted((r["path"], r[c]) for r in s.read(name).collect())
    assert facts("headings", "text") == [("a.md", "One"), ("n/b.md", "Two")] and facts("links", "target") == [("a.md", "b"), ("c.md", "gone")]
    assert facts("tags", "name") == [("a.md", "x"), ("n/b.md", "y")] and facts("blocks", "block_id") == [("n/b.md", "id1")]
    assert [r["rows"] for r in s.drift().collect()] == [0, 0] and s.read("postings").filter("term = 'moss'").count() == 1
    before = files_of(tmp_path / "s")
    s.apply(parsed(spark, [("a.md", "# New\nno link\n")]).unionByName(spark.createDataFrame([death(1, "c.md")], CHANGE), allowMissingColumns=True), 2)
    assert facts("headings", "text") == [("a.md", "New"), ("n/b.md", "Two")] and facts("links", "target") == [] and facts("tags", "name") == [("n/b.md", "y")]
    assert [r["rows"] for r in s.drift().collect()] == [0, 0] and s.read("postings").filter("term = 'moss'").count() == 0
    whole = store.Store(spark, str(tmp_path / "w"), buckets=3, indexed=True)
    whole.apply(parsed(spark, [("a.md", "# New\nno link\n"), ("n/b.md", "---\ntags: [y]\n---\n# Two\ntext ^id1\n")]), 9)
    for name in ("headings", "links", "tags", "blocks", "postings"):  # what increments keep is what a rebuild has
        assert sorted(map(str, s.read(name).collect())) == sorted(map(str, whole.read(name).collect()))
    assert before <= files_of(tmp_path / "s") and s.vacuum() > 0 and facts("headings", "text") == [("a.md", "New"), ("n/b.md", "Two")]
    s.spark.createDataFrame([("stray", "a.md", [1])], "term string, path string, positions array<int>").write.mode("append").parquet(f"{tmp_path}/s/{s.state()['epoch']}/postings/rev-2/bucket={next(iter(b for b, r in s.state()['written']['postings'].items() if r[0] == 2))}")
    assert {r["side"]: r["rows"] for r in s.drift().collect()} == {"stored": 1, "derived": 0}


def test_counters_and_vectors_of_the_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), buckets=2)
    s.apply(parsed(spark, [("a.md", "---\ntags: [y]\n---\n# One\n[[b]] #x ^id\n"), ("b.md", "# Two\n## Three\n")]), 1)
    said = lambda: {k: n for k, n in s.counters.items() if n}
    assert said() == {"documents_upserted": 2, "link_rows_written": 1, "heading_rows_written": 3, "block_rows_written": 1, "tag_rows_written": 2, "frontmatter_projections": 1}
    rows = spark.createDataFrame([("a.md", "m", "1", "h", 2, [1.0, 0.0]), ("b.md", "m", "1", "h", 2, [0.0, 1.0])], "path string, model_id string, model_version string, content_hash string, dimensions int, embedding array<float>")
    s.store_vectors(rows)
    assert said() == {"vectors_written": 2}
    s.store_vectors(rows.filter("path = 'a.md'").withColumn("content_hash", F.lit("new")))
    assert sorted((r["path"], r["content_hash"]) for r in s.read("vectors").collect()) == [("a.md", "new"), ("b.md", "h")]
    with pytest.raises(ValueError):
        s.store_vectors(rows.withColumn("path", F.lit("gone.md")))
    s.record(findings.records(spark.createDataFrame([("forbidden-field", "warning", "a.md", "zip", "1")], "code string, severity string, path string, subject string, detail string")))
    assert said() == {"findings_written": 1}
    s.apply(spark.createDataFrame([death(0, "a.md"), death(1, "never.md")], CHANGE), 2)
    assert said() == {"documents_deleted": 1, "tombstones_recorded": 2, "fact_rows_discarded": 5, "findings_discarded": 1}
    assert [r["path"] for r in s.read("vectors").collect()] == ["b.md"]
    s.apply(spark.createDataFrame([], CHANGE), 3)
    assert said() == {} and s.pin_schema("v") and said() == {"vault_schema_pins": 1}


def test_a_changeset_writes_its_own_buckets_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), buckets=16)
    s.apply(spark.createDataFrame([up(i, f"d/{i}.md", "x") for i in range(60)], CHANGE), 0)
    before = {b: r[0] for b, r in s.state()["written"]["documents"].items()}
    s.apply(spark.createDataFrame([up(0, "d/3.md", "y")], CHANGE), 1)
    after = {b: r[0] for b, r in s.state()["written"]["documents"].items()}
    assert len(before) > 8 and sum(before[b] != after[b] for b in after) == 1 and s.read("documents").count() == 60


def test_findings_go_with_their_subjects_and_classes(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), buckets=4)
    s.apply(spark.createDataFrame([up(0, "a.md", "1"), up(1, "n/b.md", "2"), up(2, "m/b.md", "3"), up(3, "c.md", "4")], CHANGE), 0)
    s.pin_schema("v1")
    found = spark.createDataFrame([("link-ambiguous", "warning", "a.md", "b", "2"), ("forbidden-field", "warning", "c.md", "zip", "1"), ("forbidden-field", "warning", "c.md", "zip", "1"), ("link-target-missing", "warning", "c.md", "x/gone", None)], "code string, severity string, path string, subject string, detail string")
    heads = spark.createDataFrame([("b", 2, ["m/b.md", "n/b.md"])], "target string, total bigint, head array<string>")
    rows = findings.records(found, heads)
    assert s.record(rows) == 3 == s.record(rows)
    stands = s.read("findings")
    assert {(r["kind"], r["fingerprint"], r["generation"]) for r in stands.collect()} == {("link-ambiguous", "v1", 2), ("forbidden-field", "v1", 2), ("link-target-missing", "v1", 2)}
    assert [(c["path"], c["suffix"]) for c in reads.findings_for_path(stands, "a.md").first()["candidates"]] == [("m/b.md", "b/m/"), ("n/b.md", "b/n/")]
    assert [r["path"] for r in reads.in_class(stands, "b/").collect()] == ["a.md"]
    ids = [r["id"] for r in reads.finding_page(stands, None, 2).collect()]
    assert ids == sorted(ids) and [r["id"] for r in reads.finding_page(stands, ids[-1], 2).collect()] == sorted({r["id"] for r in stands.collect()} - set(ids))
    s.apply(spark.createDataFrame([up(0, "k/gone.md", "5")], CHANGE), 1)  # its class is that of the missing target
    assert {r["kind"] for r in s.read("findings").collect()} == {"link-ambiguous", "forbidden-field"}
    s.apply(spark.createDataFrame([up(0, "c.md", "6")], CHANGE), 2)  # its own subject
    assert {r["kind"] for r in s.read("findings").collect()} == {"link-ambiguous"}
    s.apply(spark.createDataFrame([death(0, "m/b.md")], CHANGE), 3)  # a death touches its class too
    assert s.read("findings").count() == 0
    s.record(rows)
    with pytest.raises(ValueError):
        s.record(rows.withColumn("candidates_total", F.lit(0).cast("bigint")))
    generation = s.state()["generation"]
    assert s.pin_schema("v2") and s.read("findings").count() == 0 and s.state()["generation"] == generation + 1 and s.read("documents").count() == 4
    assert [tuple(r) for r in s.schema_pin().collect()] == [("v2", generation + 1)]
    place = findings.records(spark.createDataFrame([("document/not-utf8", "error", p, None, None) for p in ("a.md", "z.md")], found.schema))
    assert s.record(place) == 1 and s.read("findings").first()["path"] == "z.md"  # a document stands at the other
    assert [r["path"] for r in reads.finding_subjects(s.read("findings"), s.read("documents"), ["document/not-utf8"], None, 5).collect()] == ["z.md"]
    s.discard(spark.createDataFrame([("z.md",)], "path string"), ["other"])
    assert s.read("findings").count() == 1
    s.discard(spark.createDataFrame([("z.md",)], "path string"))
    assert s.read("findings").count() == 0


def test_replays_take_no_generation_and_read_what_stood(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), buckets=4)
    first = spark.createDataFrame([up(0, "a.md", "1"), up(1, "b.md", "2")], CHANGE)
    assert s.apply(first, 0, batch="q#0") == 1 == s.apply(first, 0, batch="q#0")
    start = watch.FeedStream(s.base).initialOffset()
    one = watch.FeedStream(s.base).latestOffset()
    read = lambda a, b: sorted(r for p in watch.FeedStream(s.base).partitions(a, b) for r in watch.FeedStream(s.base).read(p))
    was = read(start, one)
    s.apply(spark.createDataFrame([up(0, "a.md", "new"), death(1, "b.md")], CHANGE), 1, batch="q#1")
    two = watch.FeedStream(s.base).latestOffset()
    assert [(g, p, k) for g, p, k, _ in was] == [(1, "a.md", "document"), (1, "b.md", "document")] == [(g, p, k) for g, p, k, _ in read(start, one)]
    assert [(g, p, k) for g, p, k, _ in read(one, two)] == [(2, "a.md", "document"), (2, "b.md", "death")]
    assert s.open("v") == "rebuilt" and read({**two, "epoch": "other"}, watch.FeedStream(s.base).latestOffset()) == []


def test_open_raises_what_is_no_damage(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "s"), buckets=2)
    s.open("v1")
    s.apply(spark.createDataFrame([up(0, "a.md", "1")], CHANGE), 0)
    monkeypatch.setattr(store, "_DENIED", ["is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE"])  # as if the read had been denied
    for f in files_of(tmp_path / "s"):
        open(f, "wb").write(b"no")
    epoch = s.state()["epoch"]
    with pytest.raises(Exception):
        s.open("v1")
    assert s.state()["epoch"] == epoch
    monkeypatch.undo()
    assert s.open("v1") == "rebuilt" and s.state()["epoch"] != epoch


def test_watched_tree(spark, tmp_path):
    root = tmp_path / "v"
    (root / "n").mkdir(parents=True)
    (root / "n" / "a.md").write_text("one")
    (root / "b.md").write_text("two")
    reader = watch.TreeReader(str(root), str(tmp_path / "w"))
    rows, at = reader.read(reader.initialOffset())
    assert list(rows) == [("", False, True)] and list(reader.read(at)[0]) == []
    (root / "n" / "a.md").write_text("longer")
    rows, now = reader.read(at)
    assert list(rows) == [("n", False, False)] == list(reader.readBetweenOffsets(at, now))
    (root / "n" / "a.md").unlink()
    assert list(reader.read(now)[0]) == [("n", True, False)]
    batches = spark.createDataFrame([("n", True, False), ("n/x", False, False), ("b", False, False), ("b/c", False, False)], "root string, gone boolean, rescan boolean")
    assert sorted(r["root"] for r in watch.merge_batches(batches).collect()) == ["b", "n"]
    assert [tuple(r) for r in watch.merge_batches(batches.unionByName(batches.limit(1).withColumn("rescan", F.lit(True)))).collect()] == [("", False, True)]


def test_scoped_increment(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"), buckets=2)
    s.apply(spark.createDataFrame([up(0, "n/a.md", "1"), up(1, "n/b.md", "2"), up(2, "nx.md", "3")], CHANGE), 0)
    disk = spark.createDataFrame([up(0, "n/a.md", "new"), up(1, "nx.md", "moved too, but not dirty")], CHANGE).select(*store.DOCUMENT)
    roots = spark.createDataFrame([("n",)], "root string")
    s.apply(watch.scoped_changes(roots, disk, s.read("documents")), 1)
    assert state(s) == [("n/a.md", "new"), ("nx.md", "3")]


def test_roots(spark):
    roots = spark.createDataFrame([("a", False), ("a/b", False), ("a/c", True), ("d/e", False), ("d/e", False)], "root string, gone boolean")
    assert sorted(r["root"] for r in watch.coalesce_roots(roots).collect()) == ["a", "a/c", "d/e"]
    assert [r["root"] for r in watch.coalesce_roots(roots, most=1).collect()] == [""]


def test_vault_source(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a b.MD").write_text("é")
    (tmp_path / "n" / "x.md").write_bytes(b"\xff")
    (tmp_path / "n" / "t.txt").write_text("no")
    (tmp_path / "l.md").symlink_to(tmp_path / "n" / "x.md")
    docs = {r["path"]: r for r in vault.documents(vault.files(spark, str(tmp_path)), ["l.md"]).collect()}
    assert sorted(docs) == ["n/a b.MD", "n/x.md"] and docs["n/x.md"]["refusal"] == "not-utf8" and docs["n/a b.MD"]["text"] == "é"
    assert docs["n/a b.MD"]["content_hash"] == hashlib.sha256("é".encode()).hexdigest()
    assert [tuple(r) for r in vault.walk(spark, str(tmp_path)).collect()] == [("l.md", "symbolic-link"), ("n/a b.MD", None), ("n/t.txt", "not-markdown"), ("n/x.md", None)]


def test_edits(spark):
    body = "# A\n\none\n\n## B\ntwo\n\n# A\nthree\n"
    assert edits.edit_body(body, [{"op": "replace_section", "heading": "B", "new": "x\n"}, {"op": "str_replace", "old": "x", "new": "y"}]) == "# A\n\none\n\n## B\ny\n\n# A\nthree\n"  # blank lines around the content stay
    assert edits.apply_edit(body, {"op": "delete_section", "heading": "A", "occurrence": 1}) == "# A\nthree\n"
    assert edits.apply_edit(body, {"op": "insert_before_heading", "heading": "## B", "new": "z\n"}).count("z\n## B") == 1
    with pytest.raises(edits.EditRefused):
        edits.edit_body(body, [{"op": "delete_section", "heading": "A"}])
    assert edits.rewrite_wikilinks("[[a|t]] `[[a]]` ![[a#h]] [[b]]", "a", "c") == ("[[c|t]] `[[a]]` ![[c#h]] [[b]]", 2)
    text = "---\nt: 1 # keep\nl:\n  - x\nz: q\n---\nbody"
    assert edits.set_field(text, "l", ["y"]) == '---\nt: 1 # keep\nl: ["y"]\nz: q\n---\nbody'
    assert edits.set_field("body", "a", 1) == "---\na: 1\n---\nbody"
    df = spark.createDataFrame([(1, "ab", json.dumps([{"op": "str_replace", "old": "a", "new": "c"}]), "h", "h"), (2, "ab", "[]", "h", "g"), (3, None, "[]", "h", "h")], "id int, body string, ops string, e string, a string")
    assert [tuple(r) for r in edits.edit(df, "id", "body", "ops", "e", "a").orderBy("id").collect()] == [(1, "cb", None), (2, "ab", "hash moved"), (3, None, None)]


def test_sections_are_replaced_as_whole_lines():
    assert edits.replace_section("# h\nx\n# k\ny\n", "h", "N") == "# h\nN\n# k\ny\n"
    assert edits.replace_section("## Tail", "Tail", "NEW.") == "## Tail\nNEW.\n"
    assert edits.replace_section("## A\n\n## B\n", "A", "x") == "## A\n\nx\n\n## B\n"
    assert edits.replace_section("## A\n\nold\n\n## B\n", "A", "") == "## A\n\n\n## B\n"
    crlf = "## Alpha\r\n\r\nold\r\n\r\n## Beta\r\nb\r\n"
    assert edits.replace_section(crlf, "Alpha", "one\ntwo\n\nthree") == "## Alpha\r\n\r\none\r\ntwo\r\n\r\nthree\r\n\r\n## Beta\r\nb\r\n"
    assert edits.replace_section("## Alpha\n\nold\n\n## Beta\n", "Alpha", "one\r\ntwo") == "## Alpha\n\none\ntwo\n\n## Beta\n"
    for refused in ("> ## Quoted\n> body\n\nafter\n", "Quoted"), ("## A\nx\n\n## B\ny\n", "A", "```\nopen"), ("## A\nx\n\n## B\ny\n", "A", "## C\nz"):
        with pytest.raises(edits.EditRefused):
            edits.replace_section(refused[0], refused[1], refused[2] if len(refused) > 2 else "new")
    body = "## One\n\nContent.\n\n## Two\n"
    assert edits.apply_edit(body, {"op": "append_to_section", "heading": "One", "content": "- line"}) == "## One\n\nContent.\n- line\n\n## Two\n"
    assert edits.apply_edit("Alpha\n-----\n\nBody.\n", {"op": "insert_after_heading", "heading": "Alpha", "content": "LEAD."}) == "Alpha\n-----\nLEAD.\n\nBody.\n"
    assert edits.apply_edit("## Tail", {"op": "append_to_section", "heading": "Tail", "content": "- item"}) == "## Tail\n- item\n"


def test_fields_are_set_in_the_document_s_own_lines():
    assert edits.set_field("---\r\na: 1\r\n---\r\nbody", "b", 2) == "---\r\na: 1\r\nb: 2\r\n---\r\nbody"
    assert edits.set_field('---\n"a b": 1 # why\nc: 2\n---\n', "a b", "x") == '---\n"a b": "x" # why\nc: 2\n---\n'
    assert edits.set_field("---\na: |\n  one\n  two\n\n# note\nb: 1\n---\n", "a", None) == "---\n\n# note\nb: 1\n---\n"
    assert edits.set_field("---\n# only a comment\n---\nx", "title", "Hi") == '---\n# only a comment\ntitle: "Hi"\n---\nx'
    assert edits.set_field("\ufeffbody", "a", True) == "\ufeff---\na: true\n---\nbody"
    for text, value in (("---\n{a: 1, b: 2}\n---\n", 3), ("---\na: 1\n", 3), ("---\na: 1\n---\n", "x" * 17_000)):
        with pytest.raises(edits.EditRefused):
            edits.set_field(text, "a", value)
    assert edits.render({"title": "no", "n": 1}, "b\n") == '---\ntitle: "no"\nn: 1\n---\nb\n'
    with pytest.raises(edits.EditRefused):
        edits.rewrite_wikilinks("[[a]]", "a", "b|c")


def test_plan_refusals(spark):
    assert [r[0] for r in spark.createDataFrame([("ok",), ("a|b",), (" x",), ("Customer#1",)], "t string").select(plans.representable(F.col("t"))).collect()] == [True, False, False, False]


OPS = "kind path field old new status reason".split()


def test_set_plan_rules(spark):
    docs = spark.createDataFrame([("a.md", '{"status":"active","tags":["x"]}'), ("b.md", "{}"), ("c.md", None)], "path string, frontmatter string")
    with pytest.raises(plans.PlanRefused):
        plans.set_plan(docs, fields={"tags": "x"}, push={"tags": "y"})
    got = {(r["path"], r["field"]): (r["kind"], r["old"], r["new"], r["status"], r["reason"]) for r in plans.set_plan(docs, fields={"status": "done"}, push={"tags": "x"}, known=["status"]).collect()}
    assert got["a.md", "status"] == ("set_frontmatter", '"active"', '"done"', "planned", None) and got["c.md", "status"] == ("add_frontmatter", None, '"done"', "planned", None)
    assert got["a.md", "tags"] == ("set_frontmatter", '["x"]', '["x"]', "unchanged", "unknown-field") and got["b.md", "tags"][2:4] == ('["x"]', "planned")
    refused = plans.set_plan(docs, fields={"status": "bogus"}, allowed={"status": ["done"]})
    assert {r["status"] for r in refused.collect()} == {"refused"} and {r["status"] for r in plans.set_plan(docs, fields={"status": "bogus"}, allowed={"status": ["done"]}, force=True).collect()} == {"planned"}


def test_delete_plan_rules(spark):
    docs = spark.createDataFrame([(1, "n/a.md", "a/n/"), (2, "n/b.md", "b/n/"), (3, "m/b.md", "b/m/"), (4, "z.md", "z/")], "doc_id bigint, path string, suffix_key string")
    links = spark.createDataFrame([(4, 0, "wikilink", None, "a", None), (4, 1, "markdown", None, "n/a.md", None), (1, 0, "wikilink", None, "b", None)], "document bigint, ordinal int, family string, protocol string, target string, anchor string")
    targets = spark.createDataFrame([("a",), ("b",), ("gone",), ("z.md",)], "target string")
    got = {r["old"] or r["path"]: (r["status"], r["reason"]) for r in plans.delete_plan(targets, docs, links).collect()}
    assert got == {"n/a.md": ("refused", "backlinks: 2"), "b": ("refused", "ambiguous: m/b.md, n/b.md"), "gone": ("refused", "target-not-found"), "z.md": ("planned", None)}
    free = plans.delete_plan(targets.filter("target = 'a'"), docs, links, rewrite_to="n/b.md").collect()
    assert sorted((r["kind"], r["path"], r["new"] or "") for r in free) == [("delete_document", "n/a.md", ""), ("rewrite_link", "z.md", "/n/b.md"), ("rewrite_link", "z.md", "b")]
    assert plans.delete_plan(targets.filter("target = 'a'"), docs, links, allow_broken=True).first()["status"] == "planned"


def test_plans_are_applied_whole(spark):
    docs = spark.createDataFrame([("a.md", "---\nstatus: old\n---\n[[x]]\n"), ("b.md", "---\n{a: 1}\n---\n"), ("c.md", "c"), ("d.md", "d")], "path string, text string")
    rows = [
        ("set_frontmatter", "a.md", "status", '"old"', '"done"', None, "planned", None), ("rewrite_link", "a.md", "wikilink", "x", "y", 0, "planned", None), ("move_document", "a.md", None, "a.md", "n/a.md", None, "planned", None),
        ("set_frontmatter", "b.md", "a", "1", "2", None, "planned", None), ("delete_document", "c.md", None, "c.md", None, None, "planned", None), ("set_frontmatter", "d.md", "a", None, "1", None, "refused", "why"),
        ("create_document", "e.md", None, None, '{"type":"note"}', None, "planned", None), ("set_frontmatter", "gone.md", "a", None, "1", None, "planned", None),
    ]
    got = {r["path"]: (r["to"], r["text"], r["refusal"]) for r in plans.applied(spark.createDataFrame(rows, plans.OPERATION), docs).collect()}
    assert got["a.md"] == ("n/a.md", '---\nstatus: "done"\n---\n[[y]]\n', None) and got["c.md"] == (None, None, None)
    assert got["b.md"][1:] == ("---\n{a: 1}\n---\n", "the field can't be edited in place") and "d.md" not in got
    assert got["e.md"] == ("e.md", '---\ntype: "note"\n---\n', None) and got["gone.md"][2] == "no such document"


def test_writing_documents(tmp_path):
    h = vault.write_document(str(tmp_path), "n/a.md", b"one", None)
    assert (tmp_path / "n" / "a.md").read_bytes() == b"one" and h == hashlib.sha256(b"one").hexdigest()
    with pytest.raises(vault.WriteRefused):
        vault.write_document(str(tmp_path), "n/a.md", b"two", None)
    h2 = vault.write_document(str(tmp_path), "n/a.md", b"two", h)
    vault.write_document(str(tmp_path), "b.md", b"b", None)
    with pytest.raises(vault.WriteRefused):
        vault.move_document(str(tmp_path), "n/a.md", "b.md", h2)
    vault.move_document(str(tmp_path), "n/a.md", "m/a.md", h2)
    with pytest.raises(vault.WriteRefused):
        vault.vacate_document(str(tmp_path), "m/a.md", h)
    vault.vacate_document(str(tmp_path), "m/a.md", h2)
    assert vault.path_kind(str(tmp_path / "m" / "a.md")) == "missing" and vault.path_kind(str(tmp_path / "b.md")) == "regular-file" and vault.path_kind(str(tmp_path)) == "directory"
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["b.md"]


@pytest.mark.parametrize("folders", [1, 256])
def test_walk_facts(spark, tmp_path, monkeypatch, folders):
    import os

    monkeypatch.setattr(vault, "SPREAD_FOLDERS", folders)
    root = tmp_path / "v"
    for f in ("n/deep", "out", ".vaultframe/tmp", "skip"):
        (root / f).mkdir(parents=True)
    for f in ("a.md", "n/b.MD", "n/.md", "n/deep/c.md", ".vaultframe/tmp/x.md", "skip/y.md", "n/.a.md.shadow-12"):
        (root / f).write_text("x")
    (tmp_path / "else.md").write_text("x")
    for name, to in (("l1.md", "a.md"), ("l2", "n"), ("l3.md", "nowhere"), ("l4.md", "../else.md")):
        (root / name).symlink_to(to)
    os.mkfifo(root / "p.md")
    got = {r["path"]: (r["skip_reason"], r["detail"]) for r in vault.walk_facts(spark, str(root), ["skip"]).collect()}
    assert got == {
        "a.md": (None, None), "n/b.MD": (None, None), "n/.md": ("not-markdown", None), "n/deep/c.md": (None, None), ".vaultframe/tmp": ("mechanism", None), "skip": ("exclusion", None), "n/.a.md.shadow-12": ("shadow", None),
        "l1.md": ("symbolic-link", "in-vault-file"), "l2": ("symbolic-link", "in-vault-directory"), "l3.md": ("symbolic-link", "dangling"), "l4.md": ("symbolic-link", "outbound"), "p.md": ("special-file", "fifo"),
    }
    assert [r["path"] for r in vault.walk(spark, str(root), subtree="n").filter("skip_reason is null").collect()] == ["n/b.MD", "n/deep/c.md"]
    assert [tuple(r) for r in vault.walk_facts(spark, str(root), ["skip"], "skip").collect()] == [("skip", "exclusion", None)]


def test_class_discard_never_misses(spark):
    f = spark.createDataFrame([("c", "warning", "p", "x/v1.2", None), ("c", "warning", "p", "other", None)], "code string, severity string, path string, subject string, detail string")
    left = findings.discard_classes(f, spark.createDataFrame([("v1/",)], "class_key string"))
    assert [r["subject"] for r in left.collect()] == ["other"]


def test_embedding_is_unit_and_repeatable():
    v = vectors.embed_batch(["Hello, world", "", "hello WORLD", "日本 x"])
    assert v.dtype.name == "float32" and abs((v**2).sum(1) - 1).max() < 1e-5
    assert (v[0] == v[2]).all() and (v[0] != v[3]).any() and (v[1] > 0).sum() == 1
    one = vectors.embed_batch(["hello"])[0]
    state = int(vectors.model_seed("stub", "2"))
    for b in b"hello":
        state = (state ^ b) * 0x100000001B3 % 2**64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        state = (state ^ (state >> shift)) * factor % 2**64
    assert one[state % 64] > 0


def test_embedders_are_pluggable(spark):
    import numpy as np

    class Lengths:
        model, version, dimensions = "lengths", "1", 2

        def embed_batch(self, texts):
            return np.array([[len(t), 1] for t in texts], np.float32)

    df = spark.createDataFrame([(1, "abc", "h"), (2, None, "h"), (3, "", "k")], "doc_id bigint, body string, content_hash string")
    assert {r["doc_id"]: r["embedding"] and list(r["embedding"]) for r in vectors.embed(df, "doc_id", "body", Lengths()).collect()} == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}
    rows = vectors.vector_rows(df, "doc_id", "body", "content_hash", 7, Lengths())
    both = rows.unionByName(rows.withColumn("generation", F.lit(9).cast("bigint")).withColumn("content_hash", F.lit("new"))).unionByName(rows.withColumn("document", F.lit(99).cast("bigint")))
    kept = vectors.stored(both, df)
    assert sorted((r["document"], r["generation"], r["content_hash"]) for r in kept.collect()) == [(1, 9, "new"), (3, 9, "new")]
    assert vectors.stale(kept, df).count() == 2 and vectors.stale(rows, df).count() == 0


def test_inference_stays_out_of_findings_and_plans():
    """What is inferred never becomes a finding, a plan or a repair."""
    import ast
    from pathlib import Path

    root = Path(findings.__file__).resolve().parents[1]
    for p in [root / "operators" / f"{n}.py" for n in ("findings", "resolve", "orphans", "quarantine", "store", "predicates", "projection")] + list((root / "plans").glob("*.py")):
        names = {a.name for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names} | {n.module for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)}
        assert not any(x and "vectors" in x for x in names), p


def test_output_formats(spark):
    df = spark.createDataFrame([("b", 2), ("a", None)], "path string, n int")
    assert json.loads("".join(r[0] for r in formats.json_array(df).collect())) == [{"path": "a"}, {"path": "b", "n": 2}]
    assert json.loads("".join(r[0] for r in formats.json_array(df.filter("false")).collect())) == []
    assert [r[0] for r in formats.report(spark.createDataFrame([("x", 3), ("y", 12)], "name string, count bigint"), "all").collect()] == ["all: 15", "      12  y", "       3  x"]


def test_open_ladder(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.open("v1") == "created" and s.open("v1") == "opened"
    s.apply(spark.createDataFrame([up(0, "a.md", "1")], CHANGE), 0)
    epoch = s.state()["epoch"]
    assert s.open("v1") == "opened" and s.state()["epoch"] == epoch
    assert s.open("v2") == "rebuilt" and s.state()["epoch"] != epoch and state(s) == []


def test_prune_needs_a_walked_root(spark):
    f = spark.createDataFrame([("c", "w", p, None, None) for p in ("a/x.md", "a/y.md", "b/z.md", "ab/q.md")], "code string, severity string, path string, subject string, detail string")
    left = findings.prune(f, spark.createDataFrame([("a",)], "root string"), spark.createDataFrame([("a/y.md",)], "path string"))
    assert sorted(r["path"] for r in left.collect()) == ["a/y.md", "ab/q.md", "b/z.md"]
    heads = spark.createDataFrame([("t", 2, ["a", "b"]), ("u", 1, ["a", "b"]), ("v", 9, list("abcdef"))], "target string, total bigint, head array<string>")
    assert sorted(r["target"] for r in findings.refused(heads).collect()) == ["u", "v"]


def test_counters_and_bars(spark):
    from vaultframe.operators import observe

    df, seen = observe.counted(spark.range(10).filter("id > 3"), "r", most=F.max("id"))
    df.collect()
    assert seen.get == {"rows": 6, "most": 9}
    assert not observe.bars(df)["pairwise"] and "Physical Plan" in observe.plan_text(df)


def test_a_page_reads_from_its_cursor_on(spark, tmp_path):
    from vaultframe.operators import observe

    at = str(tmp_path / "t")
    rows = spark.range(40_000).select(F.format_string("p%06d", "id").alias("path"), F.expr("repeat('x', 50)").alias("body"))
    rows.repartitionByRange(8, "path").sortWithinPartitions("path").write.parquet(at)
    early, late = (observe.read_rows(reads.page(spark.read.parquet(at), "path", cursor, 100)) for cursor in ("p000010", "p039000"))
    assert [r["path"] for r in late[0]][:1] == ["p039001"] and len(early[0]) == len(late[0]) == 100
    assert late[1] < early[1] <= 40_000  # files that end before the cursor give no row
