"""The subpackage's operators against brute force, exact round trips and held-out accuracy, with edge cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from vaultframe.llm import chunks, cooccurrence, encoding, kernel, neardup, neighbours, packing, prose, reading
from vaultframe.session import table

WORD = regex.compile(r"[\p{L}\p{N}]+")
HARD = st.lists(st.sampled_from(list("'stmrevld aZ.é港1²!\n\r\t_-") + ["　", "﻿", "\x1c", "\x85", "İ", "ि", "<|endoftext|>"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(HARD, max_size=6))
def test_pretokens_match_the_pattern(texts):
    joined, _, begin, stop, counts = encoding.pretokens(texts)
    want = [regex.findall(encoding.PATTERN, t) for t in texts]
    assert [joined[a:b] for a, b in zip(begin, stop)] == [w for ws in want for w in ws]
    assert counts.tolist() == [len(w) for w in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(HARD, max_size=5), st.integers(1, 4))
def test_shingle_sets_match_words(texts, width):
    sets, counts = kernel.shingle_sets(texts, width)
    for t, s, n in zip(texts, sets, counts):
        w = WORD.findall(t.lower())
        assert n == len(w) and len(s) == len({tuple(w[k : k + width]) for k in range(len(w) - width + 1)})


def brute_pairs(texts, width, least, min_words):
    sets = {}
    for i, t in texts:
        w = WORD.findall((t or "").lower())
        if len(w) >= max(min_words, width):
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    keys = sorted(sets)
    return {(a, b) for x, a in enumerate(keys) for b in keys[x + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


@pytest.mark.parametrize("width,least", [(3, 0.7), (5, 0.8), (1, 0.5)])
def test_near_duplicates_are_exact(spark, width, least):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))] for _ in range(12)]
    texts = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = [rng.choice(vocabulary)]
        texts.append((i, " ".join(w)))
    texts += [(500 + k, texts[0][1].upper()) for k in range(30)]  # copies
    texts += [(900, None), (901, ""), (902, "one"), (903, "...")]
    df = spark.createDataFrame(texts, "id bigint, t string").withColumn("doc", F.lit("clash")).withColumn("mark", F.lit(0))
    found = neardup.near_duplicates(df, "id", "t", width, least, min_words=8)
    got = [tuple(r) for r in found.expanded().collect()]
    assert set(got) == brute_pairs(texts, width, least, 8) and len(got) == len(set(got))
    groups = {r["doc"]: r["grp"] for r in found.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in got) and 900 not in groups
    empty = neardup.near_duplicates(df.filter("false"), "id", "t", width, least)
    assert empty.expanded().count() == 0 and empty.groups().count() == 0


def test_large_classes_are_listed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CLASS_ROWS", 7)
    members = spark.createDataFrame([(i, 0 if i < 40 else i, i) for i in range(43)], "doc bigint, rep bigint, head bigint")
    pairs = spark.createDataFrame([(0, 41, 0.9)], "a bigint, b bigint, similarity double")
    got = [tuple(r) for r in neardup.NearDuplicates(members, pairs).expanded().collect()]
    assert sorted(got) == sorted({(a, b) for a in range(40) for b in range(a + 1, 40)} | {(a, 41) for a in range(40)})


@pytest.mark.parametrize("width,least", [(3, 0.7), (5, 0.8)])
def test_every_text_has_a_class_and_its_links(spark, width, least):
    long = "one two three four five six seven eight nine ten eleven twelve"
    texts = {1: long, 2: long.upper(), 3: long + " more", 4: "Short note", 5: "short, NOTE!", 6: "other note", 7: "", 8: "", 9: "--", 10: None, 11: None, 12: "alone with five words here", 13: "a b c d e f", 14: "A-b c d e f"}
    want = brute_pairs([(i, t) for i, t in texts.items()], width, least, 1) | {(4, 5), (7, 8)}
    df = spark.createDataFrame(list(texts.items()), "id bigint, t string")
    got = {r["doc"]: r for r in neardup.every_text(df, "id", "t", width, least).collect()}
    assert sorted(got) == sorted(texts)
    assert {i: r["links"] for i, r in got.items()} == {i: sum(i in p for p in want) for i in texts}
    assert {i: r["rep"] for i, r in got.items()} == {i: {2: 1, 5: 4, 8: 7, 14: 13}.get(i, i) for i in texts}
    assert {i: r["grp"] for i, r in got.items()} == {i: {2: 1, 3: 1, 5: 4, 8: 7, 14: 13}.get(i, i) for i in texts}


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(70)] + [(100, 101), (101, 102), (100, 102)]
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(71)}, 100: 100, 101: 100, 102: 100}


def test_encoding_round_trip_and_edges(spark):
    import tiktoken

    ranks = encoding.read_ranks(f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}")
    bpe = tiktoken.Encoding("t", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [(1, "Hello  world's end\n\n"), (2, ""), (3, None), (4, "<|endoftext|> ünï 日本"), (1, "Hello  world's end\n\n"), (5, "x" * 50_000), (6, " "), (7, "ab " * 40_000)]
    df = spark.createDataFrame(texts, "id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("block", F.lit(1))
    got = encoding.encode(df, "id", "text")
    rows = got.collect()
    assert sorted(r["id"] for r in rows) == sorted(i for i, _ in texts)
    for r in rows:
        assert list(r["ids"]) == bpe.encode_ordinary(dict(texts)[r["id"]] or "")
    back = {r["id"]: r["text"] for r in encoding.decode(got, "id", "ids").collect()}
    assert back == {i: t or "" for i, t in texts}
    assert encoding.encode(df.filter("false"), "id", "text").count() == 0
    assert encoding.encode(df.filter("id in (2, 3)"), "id", "text").count() == 2


@settings(max_examples=200, deadline=None)
@given(HARD.map(lambda t: (t + "word and it's 12 words, ") * 3), st.integers(1, 40))
def test_a_long_text_is_cut_where_pretokens_begin(text, most):
    parts = list(encoding._segments(text, most))
    assert "".join(parts) == text
    assert [w for x in parts for w in regex.findall(encoding.PATTERN, x)] == regex.findall(encoding.PATTERN, text)


def test_a_long_text_has_the_words_of_its_parts(monkeypatch):
    text = "the cat's moss, 12 rivers " * 50 + "x" * 300
    whole = encoding.block_words([text])
    monkeypatch.setattr(encoding, "BLOCK_CHARS", 64)
    words, local, counts = encoding.block_words([text])
    assert [words[k] for k in local] == [whole[0][k] for k in whole[1]] == regex.findall(encoding.PATTERN, text)
    assert counts.tolist() == [len(local)] and len(set(words)) == len(words)


def test_words_beyond_the_broadcast_are_joined(spark, monkeypatch):
    monkeypatch.setattr(encoding, "HOT_WORDS", 5)
    docs = table(spark, SF, "documents").limit(40)
    few = {r["doc_id"]: list(r["ids"]) for r in encoding.encode(docs, "doc_id", "text").collect()}
    monkeypatch.undo()
    assert few == {r["doc_id"]: list(r["ids"]) for r in encoding.encode(docs, "doc_id", "text").collect()}


def test_corpus_encodes_as_one_text_at_a_time(spark):
    import tiktoken

    ranks = encoding.read_ranks(f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}")
    bpe = tiktoken.Encoding("t", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, SF, "documents")
    want = {r["doc_id"]: bpe.encode_ordinary(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in encoding.encode(docs, "doc_id", "text").collect()} == want


BODY = st.lists(st.sampled_from(["word ", "Ende. ", "é港", "\n", "\n\n", "\r\n\r\n", "```\n", "~~~\n", "# h\n", "x" * 90, "x y " * 30, " \t\n", "。"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(BODY, min_size=1, max_size=4), st.sampled_from([(64, 16), (100, 0), (200, 50)]))
def test_pieces_cover_the_body(bodies, sizes):
    limit, overlap = sizes
    raw = [b.encode() for b in bodies if b]
    if not raw:
        return
    heads = [[(b.find(b"# h"), 1)] if b"# h" in b else [] for b in raw]
    for body, (stops, starts) in zip(raw, chunks.cuts(raw, heads, limit, overlap)):
        assert stops[0] == 0 and stops[-1] == len(body) and (np.diff(stops) > 0).all()
        for k in range(len(stops) - 1):
            assert stops[k + 1] - starts[k] <= limit
            body[starts[k] : stops[k + 1]].decode()
            assert k == 0 or overlap <= stops[k] - starts[k] <= overlap + 3 or starts[k] == 0


def brute_blocks(body, heads):
    """Blocks line by line, plainly."""
    out, fence, at, now = [], None, 0, None
    for line in regex.findall(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", body):
        text = line.rstrip(b"\r\n")
        bare = text.strip(b" \t")
        opened = None if fence else regex.match(rb" {0,3}(`{3,}|~{3,})", text)
        if opened and opened.group(1)[:1] == b"`" and b"`" in text[opened.end() :]:
            opened = None
        if not fence and not bare:
            now = None
        else:
            if now is None or (not fence and at in heads):
                now = [at, at]
                out.append(now)
            now[1] = at + len(text)
            if opened:
                fence = opened.group(1)
            elif fence and regex.fullmatch(rb" {0,3}" + regex.escape(fence[:1]) + rb"{%d,}[ \t]*" % len(fence), text):
                fence = None
        at += len(line)
    return [tuple(x) for x in out]


@settings(max_examples=300, deadline=None)
@given(BODY)
def test_blocks_match_a_plain_scan(body):
    raw = body.encode()
    heads = {m.start(): 1 for m in regex.finditer(rb"(?m)^# h", raw)}
    spans = [(s, e) for s, e, _, _ in prose.scan_blocks(raw, sorted(heads.items()))]
    inside = prose.scan_blocks(raw, [])
    fenced = [(s, e) for s, e, _, f in inside if f]
    plain = {h for h in heads if not any(s <= h < e for s, e in fenced)}
    if plain == set(heads):
        assert spans == brute_blocks(raw, heads)


def test_split_edges(spark):
    heads = spark.createDataFrame([(1, 5000, 2, False), (1, 5000, 2, False), (1, None, 1, False), (1, 99999, 1, False), (2, 10, None, True)], "document bigint, span_offset bigint, level int, inside_container boolean")
    rows = [(1, "para one. " * 400 + "\n\n## head\n" + "x" * 6000), (2, "short"), (3, None), (4, ""), (5, "港" * 3000), (1, "y" * 2001)]
    df = spark.createDataFrame(rows, "id bigint, body string").withColumn("level", F.lit(1)).withColumn("piece", F.lit("clash"))
    got = chunks.split(df, "id", "body", heads).collect()
    assert {r["id"] for r in got} == {1, 5}
    for r in got:
        assert len(r["text"].encode()) == r["stop"] - r["start"] <= 2000
        assert r["piece"] == 0 or 200 <= r["new_from"] - r["start"] <= 203
    assert chunks.split(df.filter("false"), "id", "body", heads).count() == 0
    assert chunks.split(df, "id", "body", heads.filter("false")).count() > 0
    with pytest.raises(ValueError):
        chunks.split(df, "id", "body", heads, 100, 90)


def test_tail_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(60):
        q, m = rng.random(4) ** 3, rng.integers(1, 25, 4).astype(float)
        mass = np.array([1.0])
        for a, b in zip(q, m):
            for _ in range(int(b)):
                mass = np.convolve(mass, [1 - a, a])
        for c in (0, 1, 5, int(m.sum())):
            assert cooccurrence.log_upper_tail(q, m, c) == pytest.approx(math.log(mass[c:].sum()), rel=1e-6, abs=1e-9)
    assert cooccurrence.log_upper_tail(np.array([1e-6]), np.array([1e6]), 50) < -140
    assert cooccurrence.log_upper_tail(np.array([0.5]), np.array([3.0]), 4) == -math.inf


@settings(max_examples=100, deadline=None)
@given(st.lists(BODY, min_size=1, max_size=3))
def test_a_cut_falls_in_every_oversized_block(bodies):
    raw = [b.encode() for b in bodies if b]
    blocks = [prose.scan_blocks(b, []) for b in raw]
    for own, (stops, _) in zip(blocks, chunks.block_cuts(raw, blocks, 64, 16) if raw else []):
        for start, end, _, _ in own:
            assert end - start <= 64 or ((stops > start) & (stops < end)).any()


def test_null_keeps_degrees():
    fitness, y, m = cooccurrence.fit_null({1: 40, 5: 10, 20: 2}, {1: 30, 2: 20, 6: 10})
    for k, x in fitness.items():
        assert (m * x * y / (1 + x * y)).sum() == pytest.approx(k, rel=1e-6)


@pytest.mark.parametrize("block", [4, 256])
def test_associations_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    rng = random.Random(2)
    rows = [(b, f"t{min(rng.randrange(12), rng.randrange(12))}") for b in range(120) for _ in range(rng.randrange(6))]
    rows += [(999, f"t{k}") for k in range(12)] + [(5, None), (None, "t1"), (1000, None)] + rows[:30]
    df = spark.createDataFrame(rows, "b bigint, i string").withColumn("item", F.lit("clash")).withColumn("n", F.lit(1))
    got = {(r["item_a"], r["item_b"]): r for r in cooccurrence.associations(df, "b", "i", 3, 0.0, 0.2).collect()}
    baskets: dict = {}
    for b, i in rows:
        if b is not None:
            baskets.setdefault(b, set()).update([i] if i else [])
    want: dict = {}
    for s in baskets.values():
        for x in s:
            for y in s:
                if x < y:
                    want[x, y] = want.get((x, y), 0) + 1
    assert {k: r["together"] for k, r in got.items()} == {k: c for k, c in want.items() if c >= 3}
    n = {i: sum(i in s for s in baskets.values()) for i in {i for s in baskets.values() for i in s}}
    for (x, y), r in got.items():
        assert r["lift"] == pytest.approx(r["together"] * len(baskets) / (n[x] * n[y])) and r["log_p"] <= 0
    lifted = {(r["item_a"], r["item_b"]) for r in cooccurrence.associations(df, "b", "i", 3, 1.5).collect()}
    assert lifted == {(x, y) for (x, y), c in want.items() if c >= 3 and c * len(baskets) >= 1.5 * n[x] * n[y]}
    assert cooccurrence.associations(df.filter("false"), "b", "i").count() == 0


def test_null_of_binned_histograms(spark, monkeypatch):
    sizes = spark.createDataFrame([(k,) for k in [1, 2, 2, 255, 256, 257, 258, 300, 5000, 5010, 100_000]], "s bigint")
    got = cooccurrence.histogram(sizes, "s")
    assert {k: got[k] for k in (1, 2, 255)} == {1: 1, 2: 2, 255: 1} and sum(got.values()) == 11
    assert sum(k * n for k, n in got.items()) == pytest.approx(1 + 2 + 2 + 255 + 256 + 257 + 258 + 300 + 5000 + 5010 + 100_000)
    rng = random.Random(4)
    rows = [(b, f"t{int(rng.paretovariate(0.6)) % 40}") for b in range(900) for _ in range(1 + b % 7)]
    df = spark.createDataFrame(rows, "b bigint, i string")
    whole = {(r[0], r[1]): r["expected"] for r in cooccurrence.associations(df, "b", "i", 1).collect()}
    monkeypatch.setattr(cooccurrence, "EXACT", 8)
    binned = {(r[0], r[1]): r["expected"] for r in cooccurrence.associations(df, "b", "i", 1).collect()}
    assert whole.keys() == binned.keys() and all(binned[k] == pytest.approx(e, rel=0.02) for k, e in whole.items())


def test_step_up_rule(spark):
    p = [1e-9, 1e-4, 0.004, 0.019, 0.03, 0.5]
    df = spark.createDataFrame([(math.log(x),) for x in p], "lp double")
    bound = cooccurrence.discovery_bound(df, "lp", 10, 0.05)
    k = max(i for i, x in enumerate(p, 1) if x <= 0.05 * i / 10)
    assert sum(math.log(x) <= bound for x in p) == k
    assert cooccurrence.discovery_bound(df.filter("false"), "lp", 10, 0.05) == -math.inf


def brute_neighbours(rows, k, least):
    spaces: dict = {}
    for doc, m, d, e in rows:
        if doc is not None and m is not None and e and len(e) == d and None not in e and all(map(math.isfinite, e)) and any(e):
            spaces.setdefault((m, d), []).append((doc, np.array(e, np.float32).astype(float)))
    out = set()
    for (m, d), vs in spaces.items():
        for a in {x for x, _ in vs}:
            best: dict = {}
            for x, u in vs:
                for y, w in vs:
                    if x == a != y:
                        best[y] = max(best.get(y, -2), round(float(u @ w / math.sqrt((u @ u) * (w @ w))), 12))
            for y in sorted(best, key=lambda y: (-best[y], y))[:k]:
                if best[y] >= least:
                    out.add((m, d, min(a, y), max(a, y)))
    return out


def test_neighbours_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        centre = rng.standard_normal(24)
        for j in range(rng.integers(1, 5)):
            v = (centre + 0.25 * rng.standard_normal(24)) * rng.uniform(0.1, 9)
            rows.append((len(rows), "m", 24, [float(np.float32(x)) for x in v]))
    rows += [(500 + k, "m", 24, rows[0][3]) for k in range(9)] + rows[:10]  # copies, repeats
    rows += [(900, "m", 24, None), (901, "m", 24, []), (902, "m", 24, [1.0]), (903, "m", 24, [0.0] * 24), (904, "m", 24, [float("nan")] + [1.0] * 23), (905, "m", 24, [None] + [1.0] * 23), (906, None, 24, rows[1][3]), (None, "m", 24, rows[1][3])]
    rows += [(k, "n", 2, [1.0, 0.1 * k]) for k in range(4)]
    df = spark.createDataFrame(rows, "document bigint, model_id string, dimensions int, embedding array<float>").withColumn("vid", F.lit("clash")).withColumn("h", F.lit(0))
    got = [tuple(r) for r in neighbours.neighbour_pairs(df, 5, 0.9).select("model_id", "dimensions", "doc_a", "doc_b").collect()]
    want = brute_neighbours(rows, 5, 0.9)
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.99 * len(want) > 0
    assert neighbours.neighbour_pairs(df.filter("false")).count() == 0


def test_cut_tables_find_the_same(spark, monkeypatch):
    vectors = table(spark, SF, "document_vectors")
    whole = {tuple(r) for r in neighbours.neighbour_pairs(vectors).collect()}
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    parts = {tuple(r) for r in neighbours.neighbour_pairs(vectors).collect()}
    assert parts == whole and whole


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=40), st.sampled_from([(40, 5, 40), (40, 2, 25), (60, 60, 40)]))
def test_fill_respects_all_limits(items, limits):
    tokens = np.array([t for t, _ in items])
    loss = np.minimum(np.array([x for _, x in items]), np.minimum(tokens, limits[2]))
    at = packing.fill(tokens, (tokens > 0).astype(int), loss, limits)
    for v, most in zip((tokens, (tokens > 0).astype(int), loss), limits):
        assert np.bincount(at, v).max() <= most
    assert len(set(at.tolist())) <= len(items)


def test_pack_edges(spark):
    rows = [(1, 5000, 5000), (2, 0, 0), (3, None, None), (4, 2048, 0), (5, 100, 90), (5, 100, 90), (6, 1, 7)] + [(10 + k, 40 + k * 37 % 900, 30) for k in range(400)]
    df = spark.createDataFrame(rows, "id bigint, tokens bigint, loss bigint").withColumn("part", F.lit("clash")).withColumn("grp", F.lit(1))
    got = packing.pack(df, "id").toPandas()
    assert len(got) == len(rows) + 2 and got.groupby("container").tokens.sum().max() <= 2048
    assert got[got.id == 1].tokens.tolist().count(2048) == 2 and got.tokens.sum() == sum(t or 0 for _, t, _ in rows)
    assert got.groupby("container").tokens.sum().sum() / (got.container.nunique() * 2048) > 0.98
    tight = packing.pack(df, "id", max_segments=3, max_loss=500, group_items=50).toPandas()
    assert tight.groupby("container").loss.sum().max() <= 500 and tight[tight.tokens > 0].groupby("container").size().max() <= 3
    assert tight.tokens.sum() == got.tokens.sum()
    assert packing.pack(df.filter("false"), "id").count() == 0


def test_loss_starts_at_the_body(spark):
    df = spark.createDataFrame([(1, "---\na: b\n---\nbody text", 13), (2, "x y", None), (3, None, 0)], "id bigint, text string, off bigint")
    got = {r["id"]: (r["tokens"], r["loss"]) for r in packing.token_sizes(df, "id", "text", F.col("off")).collect()}
    assert got[1][1] == 2 and got[1][0] > 2 and got[2][0] == got[2][1] == 2 and got[3] == (0, 0)


@pytest.mark.parametrize(
    "body,want",
    [
        ("One two. Three!\n\n# head\n\n- item\n  more\n\n> quote\nlazy\n\n| a |\n|---|\n\n***\n\nlast [x](y.md)", ["One two. Three!", "last [x](y.md)"]),
        ("Title\n=====\n\npara\n\n```\ncode\n\ncode\n```\nafter\n<!-- note\n\nstill -->\nend", ["para", "after", "end"]),
        ("text\n- list\n\n1. a\n\n   in list\n\nout\n\n2019. no list? yes\n", ["text", "out"]),
        ("a\r\nb\r\n\r\n+ c", ["a\nb"]),
        ("", []),
    ],
)
def test_paragraphs(body, want):
    assert prose.paragraphs(body) == want


def test_measures_count_as_stated():
    n, letters, sentences, _ = prose.measures(["Ab cd. Ef 12? e.g. x", "。あ。い", "", "# no"])
    assert n.tolist() == [7, 2, 0, 0] and letters.tolist() == [11, 2, 0, 0] and sentences.tolist() == [4, 3, 0, 0]


def test_reading_level_on_held_out_grades(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "reading_labels").filter("grade is not null")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = reading.reading_level(docs, "doc_id", "body", labels.filter(~held), "doc_id", "grade").toPandas().set_index("doc_id")
    truth = labels.filter(held).groupBy("doc_id").agg(F.avg("grade").alias("g")).toPandas()
    truth["d"] = truth.doc_id.map(got.difficulty)
    truth = truth.dropna()
    assert len(truth) >= 8 and truth.g.corr(truth.d) > 0.5
    assert len(got) == docs.count()


def test_reading_level_ranks_held_out_grades_and_converges(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "reading_labels").filter("grade is not null")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    truth = labels.filter(held).groupBy("doc_id").agg(F.avg("grade").alias("g")).toPandas()

    def ranks(style_share: float) -> float:
        got = reading.reading_level(docs, "doc_id", "body", labels.filter(~held), "doc_id", "grade", style_share=style_share)
        own = truth.assign(d=truth.doc_id.map(got.select("doc_id", "difficulty").toPandas().set_index("doc_id").difficulty)).dropna()
        assert len(own) > 100
        return own.g.rank().corr(own.d.rank())

    assert ranks(reading.STYLE_SHARE) > 0.7 and ranks(0.0) > 0.4
    clamp = labels.groupBy(F.col("doc_id").alias("doc")).agg(F.avg("grade").alias("grade"))
    facts = reading.features(docs, "doc_id", "body").join(clamp, "doc", "left").filter("words > 0")
    fitted = reading.Difficulty(facts.select("words", "letters", "sentences", "nodes", "counts", "grade"))
    assert fitted.residuals[-1] < reading.TOLERANCE and len(fitted.residuals) < reading.ITERATIONS
    assert all(b < a for a, b in zip(fitted.residuals, fitted.residuals[1:]))


def test_reading_level_edges(spark):
    rows = [(1, "Plain words here. " * 30), (2, None), (3, ""), (4, "# only a heading"), (1, "Plain words here. " * 30), (5, "z" * 100_000)]
    df = spark.createDataFrame(rows, "id bigint, body string").withColumn("words", F.lit("clash")).withColumn("grade", F.lit(1))
    labels = spark.createDataFrame([(1, 3), (1, 5), (99, 9), (4, None)], "who bigint, g int")
    got = reading.reading_level(df, "id", "body", labels, "who", "g", 3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["difficulty"] is None) == (r["words"] == 0) and r["graded"] == (r["id"] == 1)
    assert all(r["difficulty"] is None for r in reading.reading_level(df, "id", "body", labels.filter("false"), "who", "g", 3).collect())
    assert reading.reading_level(df.filter("false"), "id", "body", labels, "who", "g", 2).count() == 0


def test_nearest_documents_recall(spark):
    vectors = table(spark, SF.replace("sf0.001", "sf0.01"), "document_vectors")
    rows = [tuple(r) for r in neighbours.usable(vectors).collect()]
    got: dict = {}
    for r in neighbours.nearest_documents(vectors, 5, 10).collect():
        got.setdefault((r["model_id"], r["dimensions"], r["document"]), set()).add(r["other"])
    hit = total = 0
    for space in {r[1:3] for r in rows}:
        own = [(r[0], np.array(r[3], float)) for r in rows if r[1:3] == space]
        docs = np.array([x for x, _ in own])
        x = np.array([v / np.linalg.norm(v) for _, v in own])
        for i in np.flatnonzero(docs % 10 == 0):
            order = np.lexsort((docs, -np.round(x @ x[i], 12)))
            best = list(dict.fromkeys(int(docs[j]) for j in order if docs[j] != docs[i]))[:5]
            total += len(best)
            hit += len(set(best) & got.get((*space, int(docs[i])), set()))
    assert total > 500 and hit >= 0.9 * total  # the bound the operator promises


def test_nearest_documents_of_a_crowd_are_exact(spark):
    """More nearly equal, distinct vectors than any fixed number kept, and one vector with many owners."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    crowd = [(d, (centre + 1e-3 * rng.standard_normal(16)).astype(np.float32)) for d in range(1500)]
    rows = crowd + [(d, crowd[3][1]) for d in range(2000, 2040)] + [(d, rng.standard_normal(16).astype(np.float32)) for d in range(3000, 3100)]
    rows += [(50, rows[-1][1]), (7, crowd[50][1])]  # documents with two vectors
    df = spark.createDataFrame([(d, "m", 16, v.tolist()) for d, v in rows], "document bigint, model_id string, dimensions int, embedding array<float>")
    got: dict = {}
    for r in neighbours.nearest_documents(df, 5, 50).orderBy("document", "rank").collect():
        got.setdefault(r["document"], []).append((r["other"], r["cosine"]))
    docs = np.array([d for d, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for d in {int(d) for d in docs if d % 50 == 0}:
        best: dict = {}
        for i in np.flatnonzero(docs == d):
            for o, c in zip(docs.tolist(), np.round(x @ x[i], 12)):
                if o != d:
                    best[o] = max(best.get(o, -2), c)
        assert [o for o, _ in got.pop(d)] == [o for _, o in sorted((-c, o) for o, c in best.items())[:5]]
    assert not got
