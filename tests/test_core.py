"""Core operators against brute force, literals and edge cases."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from vaultframe.functions import frontmatter, markdown
from vaultframe.operators import orphans, paths, shred
from vaultframe.session import hot_keys, skew_join, table

JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab~/\"", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab~/", max_size=2), x, max_size=3), max_leaves=20)


def brute_objects(x, at="", inside="", root=True):
    if isinstance(x, dict):
        own = [] if root else [(at, inside)]
        return own + [n for k, v in x.items() for n in brute_objects(v, f"{at}/{shred.escape(k)}", "" if root else at, False)]
    if isinstance(x, list):
        return [n for i, v in enumerate(x) for n in brute_objects(v, f"{at}/{i}", inside, False)]
    return []


@settings(max_examples=300, deadline=None)
@given(JSON)
def test_objects_rebuilt_from_levels(x):
    got = [n for p in shred.shred_record(json.dumps(x)) for n in shred.record_objects(*p[:5])]
    assert sorted(got) == sorted(brute_objects(x))


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_every_scalar_is_one_cell(x):
    def scalars(x):
        return [v for y in (x.values() if isinstance(x, dict) else x) for v in scalars(y)] if isinstance(x, (dict, list)) else [x]

    got = [c[5] for path, kind, _, r, d, v in shred.shred_record(json.dumps(x)) if kind == "value" for c in shred.record_cells(path, kind, r, d, v)]
    assert sorted(got) == sorted(json.dumps(v, ensure_ascii=False) for v in scalars(x))


def test_number_spelling_survives():
    (row,) = shred.shred_record('{"z":1.0}')
    assert row[5] == ["1.0"]


def test_shred_edges(spark):
    rows = [(1, None), (2, ""), (3, "not json"), (4, "{}"), (5, '{"a":[{},{"b":{"c":null}}]}'), (5, '{"a":[{},{"b":{"c":null}}]}'), (6, json.dumps({"k": ["x" * 200_000, {"y": {}}]})), (7, '"\\ud800"')]
    df = spark.createDataFrame(rows, "id bigint, j string").withColumn("path", F.lit("clash")).withColumn("node", F.lit("clash"))
    levels = shred.shred(df, "id", "j")
    got = sorted(map(tuple, shred.objects(levels).collect()))
    assert got == sorted([(5, "/a/0", ""), (5, "/a/1", ""), (5, "/a/1/b", "/a/1")] * 2 + [(6, "/k/1", ""), (6, "/k/1/y", "/k/1")])
    assert shred.objects(shred.shred(df.filter("false"), "id", "j")).count() == 0
    wide = shred.flat_table(shred.cells(levels), "/a/~", ["b/c"]).filter("record = 5").orderBy("node").collect()
    assert [tuple(r) for r in wide] == [(5, "/a/0", "", None), (5, "/a/1", "", "null")]  # an empty object is a row too
    deep = '{"a":' * 300 + "{}" + "}" * 300
    assert shred.objects(shred.shred(spark.createDataFrame([(1, deep)], "id bigint, j string"), "id", "j")).count() == 300


def brute_missing(docs, heads, links):
    def stem(s):
        i = s.rfind(".")
        return s[:i] if i > 0 else s

    by_suffix, by_path, own = {}, {}, {i for i, _ in docs}
    for i, p in docs:
        segs = p.split("/")
        segs[-1] = stem(segs[-1])
        for k in range(len(segs)):
            by_suffix.setdefault("/".join(segs[k:]), []).append(i)
        by_path[p] = [i]
    home = dict(docs)
    out = set()
    for doc, n, family, protocol, target, anchor in links:
        if protocol is not None:
            continue
        if target is None:
            found = []
        elif target == "":
            found = [doc] if doc in own else []
        elif family == "wikilink":
            head, bar, leaf = target.rpartition("/")
            found = by_suffix.get(target, []) + by_suffix.get(head + bar + stem(leaf), [])
        else:
            at = [] if target.startswith("/") else (home.get(doc) or "").split("/")[:-1]
            for s in target.lstrip("/").split("/"):
                if s == ".." and not at:
                    at = None
                    break
                at = at[:-1] if s == ".." else at if s in (".", "") else [*at, s]
            found = by_path.get("/".join(at), []) if at is not None else []
        if not found:
            out.add((doc, n, "documents"))
        elif anchor is not None and not any(h[0] in found and (h[1] if family == "wikilink" else h[2]) == anchor for h in heads):
            out.add((doc, n, "headings"))
    return out


def test_orphans_brute_force(spark):
    rng = random.Random(5)
    names = ["a.md", "b.c.md", ".x.md", "x/a.md", "x/y/a.md", "x/y/v1.2.md", "z/é.MD", "n"]
    docs = [(i, p) for i, p in enumerate(names)]
    heads = [(i, rng.choice(["T", "U v"]), rng.choice(["t", "u-v"])) for i in range(6) for _ in range(2)]
    targets = ["", "a", "a.md", "x/a", "y/a", "/a", "b", "b.c", "v1.2", "v1", ".x", "nope", "../a.md", "./a.md", "../../a.md", "/x/a.md", "y/a.md", "x//a.md", "é", None, "a" * 5000]
    links = [(rng.randrange(9), n, rng.choice(["wikilink", "markdown"]), rng.choice([None, None, None, "https"]), rng.choice(targets), rng.choice([None, "T", "t", "u-v", ""])) for n in range(600)]
    links += links[:50] + [(0, 1000 + k, "wikilink", None, "a", None) for k in range(400)]  # repeats, and a hot target
    d = spark.createDataFrame(docs, "doc_id bigint, path string").withColumn("target", F.lit("clash"))
    h = spark.createDataFrame(heads, "document bigint, text string, slug string").withColumn("path", F.lit("clash"))
    x = spark.createDataFrame(links, "document bigint, ordinal int, family string, protocol string, target string, anchor string").withColumn("path", F.lit("clash"))
    got = [tuple(r) for r in orphans.orphan_links(x, d, h).collect()]
    assert set(got) == brute_missing(docs, heads, links) and len(got) == len(set(got))
    none = d.filter("false")
    assert orphans.orphan_links(x, none, h.filter("false")).count() == len({(r[0], r[1]) for r in links if r[3] is None})
    assert orphans.orphan_links(x.filter("false"), d, h).count() == 0


def test_missing_keys_edges(spark):
    p = spark.createDataFrame([("a",), ("a",), ("é",), (None,), ("b\u0000",)], "key string")
    q = spark.createDataFrame([("a",), ("b",), ("b\u0000",), ("é",), ("é",), (None,), ("zz",), ("zz",)], "key string")
    assert sorted(r[0] for r in orphans.missing_keys(p, q, ranges=3).collect()) == ["b", "zz"]


def test_skew_join_matches_plain(spark):
    left = spark.createDataFrame([(1, i) for i in range(900)] + [(k, k) for k in range(2, 60)] + [(None, 1)], "k int, v int")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 40)], "k int, w string")
    assert hot_keys(left, "k", 0.1) == [1]
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = skew_join(left, right, "k", how, 0.1), left.join(right, "k", how)
        assert sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize(
    "path,key",
    [("docs/guide/glossary.md", "glossary/guide/docs/"), ("a.md", "a/"), ("x/.gitignore", ".gitignore/x/"), ("n/notes.tar.gz", "notes.tar/n/"), ("v1.2", "v1/")],
)
def test_suffix_key(spark, path, key):
    assert spark.range(1).select(paths.suffix_key(F.lit(path))).first()[0] == key


def test_probes_are_segment_aligned(spark):
    df = spark.createDataFrame([("glossary/guidetest/docs/",), ("glossary/guide/docs/",)], "suffix_key string").withColumn("path", F.lit("p"))
    from vaultframe.operators import reads

    assert [r[0] for r in reads.suffix_candidates(df, "guide/glossary").collect()] == ["glossary/guide/docs/"]
    assert sorted(spark.range(1).select(paths.probe_keys(F.lit("v1.2"))).first()[0]) == ["v1.2/", "v1/"]


@pytest.mark.parametrize(
    "text,facts",
    [
        ("![[Note#Heading|Shown]]", [("wikilink", True, "Note", "Heading", "Shown", None)]),
        ("[[#Heading]]", [("wikilink", False, "", "Heading", None, None)]),
        ("[[a]](b)", [("wikilink", False, "a", None, None, None)]),
        ("[[a^b]] [[x#^id]]", [("wikilink", False, "a^b", None, None, None), ("wikilink", False, "x", None, None, "id")]),
        ("`[[no]]` and\n```\n[[no]]\n```\n[t](u.md#s)", [("markdown", False, "u.md", "s", "t", None)]),
        ("[[note:draft]] [[HTTPS://x]]", [("wikilink", False, "note:draft", None, None, None), ("wikilink", False, "HTTPS://x", None, None, None)]),
        ("![alt](i.png) <https://x> [ref][r]", []),
    ],
)
def test_links(text, facts):
    got = [(x["family"], x["embed"], x["target"], x["anchor"], x["title"], x["block_ref"]) for x in markdown.Body(text).links if x["target"] != "b"]
    assert got == facts


def test_tags_slugs_blocks():
    names = [t["name"] for t in markdown.Body("foo#bar #123 (#tag) #a.b #हिन्दी\n# h\n<!-- #no -->\n`#no`").tags]
    assert names == ["tag", "a", "हिन्दी"]
    slugs = markdown.Slugs()
    assert [slugs.issue(x) for x in ("a", "a-1", "a", "a", "What? Really!", "A  B")] == ["a", "a-1", "a-2", "a-3", "what-really", "a--b"]
    assert [b["block_id"] for b in markdown.Body("text ^one\n\n```\nx ^no\n```\n^two").blocks] == ["one", "two"]


@pytest.mark.parametrize(
    "text,json_",
    [
        ("---\npublish: no\nzip: 0777\nt: 12:34:56\nd: 2026-07-29\n---\n", '{"d":"2026-07-29","publish":"no","t":"12:34:56","zip":"0777"}'),
        ("---\n---\nx", "{}"),
        ("x", None),
        ("---\na: 1.0\nb: 2\nc: [~, true]\n---", '{"a":1.0,"b":2,"c":[null,true]}'),
        ("﻿---\r\na: b\r\n---\r\nbody", '{"a":"b"}'),
        ("---\nx: [1\n---\nbody", None),
        ("---\na: 1\n", None),
        ("---\nbase: &b {x: 1, y: 2}\nuse:\n  <<: *b\n  y: 3\n---\n", '{"base":{"x":1,"y":2},"use":{"x":1,"y":3}}'),
    ],
)
def test_frontmatter(text, json_):
    block = frontmatter.read(text)
    assert (None if block.value is None else frontmatter.canonical(block.value)) == json_


def test_frontmatter_bounds():
    assert frontmatter.read("---\nk: " + "x" * 16381 + "\n---\nb").status == "too-large"
    assert frontmatter.read("---\na: 1").status == "unclosed"


def test_spans_count_bytes():
    spans = markdown.Spans("é\r\nab\rc")
    assert [spans.at(i) for i in (0, 3, 6)] == [(1, 1, 0), (2, 1, 4), (3, 1, 7)]


def test_whole_tables_agree_with_their_texts(spark):
    from vaultframe.functions import parse

    parsed = parse.parse(table(spark, SF, "documents"), "doc_id", "text").cache()
    for name, of in (("headings", "headings"), ("links", "links"), ("tags", "document_tags")):
        got = parse.facts(parsed, "doc_id", name)
        want = table(spark, SF, of).select(*got.columns).distinct()
        assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_spread_only_touches_narrow_scans(spark):
    from vaultframe.session import spread

    docs = table(spark, SF, "documents").select("doc_id")
    assert docs.rdd.getNumPartitions() == 1 and spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = docs.groupBy("doc_id").count()
    assert spread(grouped) is grouped


def test_missing_blocks_across_documents(spark):
    from vaultframe.operators import findings

    docs = spark.createDataFrame([(1, "a/one.md"), (2, "a/two.md"), (3, "b/two.md")], "doc_id bigint, path string")
    blocks = spark.createDataFrame([(1, "x"), (3, "y")], "document bigint, block_id string")
    rows = [
        (1, 0, "wikilink", None, "", "x"), (1, 1, "wikilink", None, "", "gone"), (2, 0, "wikilink", None, "one", "x"), (2, 1, "wikilink", None, "one", "gone"),
        (1, 2, "wikilink", None, "two", "y"), (1, 3, "wikilink", None, "a/two", "y"), (1, 4, "wikilink", None, "nowhere", "x"), (2, 2, "markdown", None, "one.md", "x"),
        (2, 3, "markdown", None, "one.md", "gone"), (2, 4, "markdown", "https", "one.md", "gone"), (2, 1, "wikilink", None, "one", "gone"), (2, 5, "wikilink", None, "one", None),
    ]
    links = spark.createDataFrame([(*r, None) for r in rows], "document bigint, ordinal int, family string, protocol string, target string, block_ref string, anchor string")
    got = sorted((r["path"], r["subject"], r["detail"]) for r in findings.block_missing(links, blocks, docs).collect())
    assert got == [("a/one.md", "", "gone"), ("a/one.md", "a/two", "y"), ("a/two.md", "one", "gone"), ("a/two.md", "one.md", "gone")]


def test_records_of_any_depth(spark):
    deep = '{"o": {"k": 1}, "a": ' + "[" * 60_000 + "]" * 60_000 + "}"
    assert shred._deep_loads('{"a": [1.0, {"b": "\\u00e9"}, [], {}, null, true], "c": -2e5}') == {"a": ["1.0", {"b": "é"}, [], {}, None, True], "c": "-2e5"}
    for bad in ("", "[", "[1,]", '{"a" 1}', '{"a":1,}', "1 2", "[1}", "nope"):
        with pytest.raises(ValueError):
            shred._deep_loads(bad)
    df = spark.createDataFrame([(1, deep), (2, "[" * 60_000)], "id int, j string")
    assert [tuple(r) for r in shred.objects(shred.shred(df, "id", "j")).collect()] == [(1, "/o", "")]
    cell = shred.cells(shred.shred(df, "id", "j")).filter("value = '1'").collect()
    assert [(r["record"], r["table"], r["column"]) for r in cell] == [(1, "", "o/k")]


def test_a_cluster_must_name_its_checkpoint_folder(monkeypatch):
    from types import SimpleNamespace as S

    from vaultframe import session

    conf = {}
    spark = S(sparkContext=S(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(spark)
    conf["spark.checkpoint.dir"] = "hdfs://shared/x/"
    assert session.checkpoint_dir(spark) == "hdfs://shared/x"


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_skew_join_with_many_hot_keys(spark, how):
    from vaultframe.session import hot_keys, skew_join

    left = spark.range(5000).select((F.col("id") % 900).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k bigint, id bigint"))
    right = spark.range(0, 1800, 2).select(F.col("id").alias("k"), F.lit("r").alias("v"))
    assert len(hot_keys(left, "k", rows=4)) == 900
    got = skew_join(left, right, "k", how, rows=4)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_scratch_deletes_what_was_written(spark):
    from pathlib import Path

    from vaultframe.session import materialize, scratch

    with scratch():
        at = materialize(spark.range(3).toDF("id"), "t").inputFiles()[0]
        assert Path(at.removeprefix("file://").removeprefix("file:")).exists()
    assert not Path(at.removeprefix("file://").removeprefix("file:")).exists()


def test_missing_keys_in_small_ranges(spark):
    parents = spark.createDataFrame([(f"k{i}é",) for i in range(0, 400, 2)], "key string")
    probes = spark.createDataFrame([(f"k{i % 300}é",) for i in range(900)] + [(None,), ("",)], "key string")
    want = sorted([f"k{i}é" for i in range(1, 300, 2)] + [""])
    for ranges in (None, 1, 7):
        assert sorted(r[0] for r in orphans.missing_keys(parents, probes, ranges=ranges).collect()) == want
