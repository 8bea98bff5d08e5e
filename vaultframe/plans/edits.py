"""Lossless edits of one document's text. Pure functions over strings; `edit` maps them over a DataFrame.

Every byte an edit isn't about stays. What is written has the line ends the document has; a result is read again before it is
returned, and one that doesn't read back as meant is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vaultframe.functions import frontmatter, markdown


class EditRefused(ValueError):
    """The text is left as it was."""


_BREAK = re.compile(r"\r\n|\n|\r")
_PLAIN_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*$")
OPERATIONS = ["str_replace", "replace_section", "append_to_section", "delete_section", "insert_before_heading", "insert_after_heading"]


def line_end(text: str) -> str:
    """CR LF if the text's first line ends so, else LF."""
    first = _BREAK.search(text)
    return "\r\n" if first and first.group() == "\r\n" else "\n"


def _lines(content: str, end: str) -> str:
    """Content as whole lines of one line end."""
    return _BREAK.sub(end, content) + ("" if not content or _BREAK.search(content[-1]) else end)


def _chars(body: str, byte: int) -> int:
    return len(body.encode()[:byte].decode()) if not body.isascii() else byte


def content_bounds(body: str, start: int, end: int) -> tuple[int, int]:
    """[start, end) without the blank lines at its edges; (end, end) if nothing else is there."""
    lines, at = [], start
    for m in _BREAK.finditer(body, start, end):
        lines.append((at, m.end()))
        at = m.end()
    if at < end:
        lines.append((at, end))
    full = [(a, b) for a, b in lines if body[a:b].strip()]
    return (full[0][0], full[-1][1]) if full else (end, end)


class Section:
    """Character offsets of a section: `start` of its heading, `body` after the heading's line, `content` .. `content_end` without blank
    lines at the edges, `end` where the next heading of its level or above begins."""

    def __init__(self, body: str, heads: list[dict], h: dict) -> None:
        later = [x for x in heads if x["ordinal"] > h["ordinal"] and x["level"] <= h["level"]]
        self.start, self.body = _chars(body, h["span_offset"]), _chars(body, h["body_offset"])
        self.end = _chars(body, later[0]["span_offset"]) if later else len(body)
        self.content, self.content_end = content_bounds(body, self.body, self.end)
        self.inside_container = h["inside_container"]


def find_section(body: str, heading: str, occurrence: int | None = None) -> Section:
    """The section under an exact heading text, or one spelled like an ATX line if no text fits. Ambiguous unless `occurrence` (from 1) says
    which."""
    heads = markdown.Body(body).headings
    hits = [h for h in heads if h["text"] == heading]
    if not hits and heading.startswith("#"):
        marks, _, text = heading.partition(" ")
        hits = [h for h in heads if h["level"] == len(marks) and h["text"] == text.strip()]
    if not hits:
        raise EditRefused("no such heading")
    if occurrence is None and len(hits) > 1:
        raise EditRefused("ambiguous heading")
    if not 1 <= (occurrence or 1) <= len(hits):
        raise EditRefused("no such occurrence")
    return Section(body, heads, hits[(occurrence or 1) - 1])


def section(body: str, heading: str, occurrence: int | None = None) -> tuple[int, int, int]:
    """(heading start, content start, end) in characters, blank lines included."""
    s = find_section(body, heading, occurrence)
    return s.start, s.body, s.end


def _spliced(body: str, start: int, stop: int, new: str) -> str:
    """body with [start, stop) replaced; refused if a heading outside of it would be lost or moved in rank."""
    edited = body[:start] + new + body[stop:]
    shift = len(new) - (stop - start)
    there = {(_chars(edited, h["span_offset"]), h["text"], h["level"]) for h in markdown.Body(edited).headings}
    for h in markdown.Body(body).headings:
        at = _chars(body, h["span_offset"])
        if not start <= at < stop and (at if at < start else at + shift, h["text"], h["level"]) not in there:
            raise EditRefused("the edit would lose a heading")
    return edited


def _put(body: str, at: int, content: str) -> str:
    """Content as whole lines at a line's start; a line end first where the text before has none."""
    end = line_end(body)
    lead = end if at > 0 and body[at - 1] not in "\r\n" else ""
    return _spliced(body, at, at, lead + _lines(content, end))


def replace_section(body: str, heading: str, content: str, occurrence: int | None = None) -> str:
    """The section's content replaced; its heading and the blank lines around the content stay. Refused in a block quote or list item, and where
    the section wouldn't read back as the content given."""
    s = find_section(body, heading, occurrence)
    if s.inside_container:
        raise EditRefused("the section is inside a container")
    end = line_end(body)
    new = _lines(content, end)
    if new:
        if s.content and body[s.content - 1] not in "\r\n":
            new = end + new
        if s.content == s.content_end == s.end and s.body < s.end < len(body):
            new += end  # an empty section's blank lines stand above the new content, and one must follow it
    edited = _spliced(body, s.content, s.content_end, new)
    now = find_section(edited, heading, occurrence)
    if _lines(edited[now.content : now.content_end], "\n").strip("\n") != _lines(content, "\n").strip("\n"):
        raise EditRefused("the section would not read back as given")
    return edited


def apply_edit(body: str, op: dict) -> str:
    kind = op.get("op")
    if kind not in OPERATIONS:
        raise EditRefused(f"unknown operation {kind}")
    if kind == "str_replace":
        if not op["old"] or body.count(op["old"]) != 1:
            raise EditRefused("the old text must occur once")
        return body.replace(op["old"], op["new"])
    content = op.get("content", op.get("new", ""))
    if kind == "replace_section":
        return replace_section(body, op["heading"], content, op.get("occurrence"))
    s = find_section(body, op["heading"], op.get("occurrence"))
    if s.inside_container:
        raise EditRefused("the section is inside a container")
    if kind == "delete_section":
        return _spliced(body, s.start, s.end, "")
    if kind == "insert_before_heading":
        try:
            return _put(body, s.start, content)
        except EditRefused:  # an underlined heading would take the content for its own text
            return _put(body, s.start, _lines(content, line_end(body)) + line_end(body))
    if kind == "insert_after_heading":
        return _put(body, s.body, content)
    if s.content == s.content_end:
        return replace_section(body, op["heading"], content, op.get("occurrence"))
    return _put(body, s.content_end, content)


def edit_body(body: str, ops: list[dict]) -> str:
    """All operations in order, each on the last one's result; if one is refused, none holds."""
    for op in ops:
        body = apply_edit(body, op)
    return body


def _entry(field: str, value, end: str) -> str:
    key = field if _PLAIN_KEY.match(field) and field not in frontmatter.WORDS else json.dumps(field, ensure_ascii=False)
    return f"{key}: {json.dumps(value, ensure_ascii=False)}{end}"


def set_field(text: str, field: str, value) -> str:
    """The document with one top-level frontmatter field set, every other byte as it was; null removes the field, its continuation lines
    with it. Values are written as JSON, which YAML reads alike. A document without a block gets one, after a byte order mark."""
    block = frontmatter.read(text)
    if block.status in ("unclosed", "too-large", "unreadable"):
        raise EditRefused(f"frontmatter is {block.status}")
    end = line_end(text)
    line = "" if value is None else _entry(field, value, end)
    if block.status == "none":
        mark = "﻿" if text.startswith("﻿") else ""
        edited = text if value is None else f"{mark}---{end}{line}---{end}{text[len(mark):]}"
        expected = {} if value is None else {field: value}
    else:
        spans = [(a, b) for name, a, b in frontmatter.entries(text) if name == field]
        if len(spans) > 1 or field in block.value and not spans:
            raise EditRefused("the field can't be edited in place")
        start, stop = spans[0] if spans else (block.stop, block.stop)
        own = [(a, b) for name, a, b, style in frontmatter.fields(text) if name == field and style in ("plain", "single", "double", "flow-sequence", "flow-map")]
        if own and value is not None and not _BREAK.search(text[start : own[0][1]]):  # one line: its key and comment stay too
            start, stop, line = *own[0], json.dumps(value, ensure_ascii=False)
        edited = text[:start] + line + text[stop:]
        expected = {k: v for k, v in block.value.items() if k != field} | ({} if value is None else {field: value})
    now = frontmatter.read(edited)
    if now.status == "too-large":
        raise EditRefused("frontmatter would be too large")
    if (now.value or {}) != expected or edited[now.body_start :].lstrip("﻿") != text[block.body_start :].lstrip("﻿"):
        raise EditRefused("the edit would not read back as given")
    return edited


def render(fields: dict, body: str) -> str:
    """A document of some fields, in order, and a body. Without fields it is the body, unless that would read as frontmatter itself."""
    if not fields and frontmatter.locate(body).status == "none":
        return body
    text = "---\n" + "".join(_entry(k, v, "\n") for k, v in fields.items()) + "---\n" + body
    if frontmatter.read(text).value != fields:
        raise EditRefused("the fields would not read back as given")
    return text


def representable(target: str) -> bool:
    """Whether a name can be a wikilink's target as it is: no mark of the syntax, no line end, no white space at its edges."""
    return bool(target) and target == target.strip() and not re.search(r"[\[\]|#\r\n]", target)


def rewrite_wikilinks(body: str, target: str, to: str) -> tuple[str, int]:
    """The body with wikilinks that spell `target` spelling `to`; anchors, titles and everything in code stay. And how many there were.
    Refused if `to` can't be written as a target."""
    if not representable(to):
        raise EditRefused("not a valid wikilink target")
    out, at, n = [], 0, 0
    for link in markdown.Body(body).links:
        if link["family"] == "wikilink" and link["protocol"] is None and link["target"] == target:
            begin = body.index("[[", link["at"]) + 2
            begin = body.index(target, begin)
            out.append(body[at:begin] + to)
            at, n = begin + len(target), n + 1
    return "".join(out) + body[at:], n


def edit(df: DataFrame, key: str, body: str, ops: str, expected: str | None = None, actual: str | None = None) -> DataFrame:
    """(key, body, refusal): each row's JSON list of operations applied to its body. With `expected` and `actual` hash columns, a row whose
    hashes differ is refused: compare and swap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, why = [], []
            columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
            for row in zip(*columns):
                try:
                    if len(row) == 4 and row[2] != row[3]:
                        raise EditRefused("hash moved")
                    bodies.append(edit_body(row[0], json.loads(row[1] or "[]")) if row[0] is not None else None)
                    why.append(None)
                except EditRefused as e:
                    bodies.append(row[0])
                    why.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(why, pa.string())], names=[key, "body", "refusal"])

    cas = [expected, actual] if expected and actual else []
    return df.select(key, body, ops, *cas).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, body string, refusal string")


def set_fields(df: DataFrame, key: str, text: str, field: str, value: str) -> DataFrame:
    """(key, text, refusal): each row's field set to the JSON in `value`; a null value removes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, why = [], []
            for t, f, v in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                try:
                    texts.append(None if t is None else set_field(t, f, None if v is None else json.loads(v)))
                    why.append(None)
                except EditRefused as e:
                    texts.append(t)
                    why.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(why, pa.string())], names=[key, "text", "refusal"])

    return df.select(key, text, field, value).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string, refusal string")


def sections(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, ordinal, text, start, stop, content): every section, character offsets, and its content without the blank lines at its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                heads = markdown.Body(t).headings if t else []
                for h in heads:
                    s = Section(t, heads, h)
                    rows.append((h["ordinal"], h["text"], s.start, s.end, t[s.content : s.content_end]))
                    at.append(i)
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, "ordinal", "text", "start", "stop", "content"])

    return df.select(key, body).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ordinal int, text string, start bigint, stop bigint, content string")
