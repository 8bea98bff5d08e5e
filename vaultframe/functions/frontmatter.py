"""The frontmatter block: where it is, its values by the YAML 1.2 core schema, and their canonical JSON.

Seven shapes: null, bool, int, float, string, sequence, map. Plain `no`, `0777`, dates and times are strings. Merge keys are folded, explicit
tags stripped, non-string keys dropped and repeated keys kept once; each of these counts as a diagnostic.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

import yaml

_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

MAX_BYTES = 16 * 1024
MAX_DEPTH = 256
_OPEN = re.compile("\ufeff?---[ \t]*(?:\r\n|\n|\r)")
_CLOSE = re.compile(r"(?:^|(?<=\n)|(?<=\r))---[ \t]*(?:\r\n|\n|\r|$)")
_INT = re.compile(r"[-+]?(?:0|[1-9][0-9]*)$")
_RADIX = re.compile(r"(?:0o[0-7]+|0x[0-9a-fA-F]+)$")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|(?:0|[1-9][0-9]*)(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$")
# Fixed values of the YAML 1.2 core schema.
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_INFINITE = re.compile(r"[-+]?\.(?:inf|Inf|INF)$|\.(?:nan|NaN|NAN)$")


class Refused(Exception):
    """The block is there and can't be read."""


class Block:
    """(status, body_start, start, stop): status is 'none', 'unclosed', 'too-large', 'unreadable' or 'read'; start and stop bound the YAML."""

    __slots__ = ("status", "body_start", "start", "stop", "value", "diagnostics", "strings")

    def __init__(self, status: str, body_start: int, start: int = 0, stop: int = 0) -> None:
        self.status, self.body_start, self.start, self.stop = status, body_start, start, stop
        self.value, self.diagnostics, self.strings = None, 0, []


def locate(text: str) -> Block:
    """The leading block by its delimiters alone; offsets in characters of the text."""
    opened = _OPEN.match(text)
    if not opened:
        return Block("none", 1 if text.startswith("\ufeff") else 0)
    closed = _CLOSE.search(text, opened.end())
    if not closed:
        return Block("unclosed", 1 if text.startswith("\ufeff") else 0)
    block = Block("read", closed.end(), opened.end(), closed.start())
    if len(text[block.start : block.stop].encode()) > MAX_BYTES:
        block.status = "too-large"
    return block


class _Reader:
    def __init__(self) -> None:
        self.diagnostics = 0

    def scalar(self, node):
        value = node.value
        if node.style is not None and node.style != "":
            return value
        if value in WORDS:
            return WORDS[value]
        if _INT.match(value) or _RADIX.match(value):
            n = int(value) if _INT.match(value) else int(value, 0)
            if -(1 << 63) <= n < 1 << 63:
                return n
            self.diagnostics += 1
            if n < 1 << 64 and n >= 0:
                return float(n)
            raise Refused("an integer out of range")
        if _INFINITE.match(value):
            return float(value.replace(".", "", 1))
        if _FLOAT.match(value) and any(c.isdigit() for c in value):
            return float(value)
        return value

    def read(self, node, depth: int = 0):
        if depth > MAX_DEPTH:
            raise Refused("nested too deeply")
        if isinstance(node, yaml.ScalarNode):
            if node.tag and not node.tag.startswith("tag:yaml.org,2002:"):
                self.diagnostics += 1
            return self.scalar(node)
        if isinstance(node, yaml.SequenceNode):
            return [self.read(x, depth + 1) for x in node.value]
        out: dict = {}
        merged: dict = {}
        for key, value in node.value:
            if isinstance(key, yaml.ScalarNode) and key.value == "<<" and key.style in (None, ""):
                self.diagnostics += 1
                for source in value.value if isinstance(value, yaml.SequenceNode) else [value]:
                    if isinstance(source, yaml.MappingNode):
                        for k, v in self.read(source, depth + 1).items():
                            merged.setdefault(k, v)
                continue
            name = self.scalar(key) if isinstance(key, yaml.ScalarNode) else None
            if not isinstance(name, str):
                self.diagnostics += 1
                continue
            if name in out:
                self.diagnostics += 1
            out[name] = self.read(value, depth + 1)
        return {**out, **{k: v for k, v in merged.items() if k not in out}}


def read(text: str) -> Block:
    """The block with its value (a dict), the number of diagnostics, and the string scalars of each field with their places."""
    block = locate(text)
    if block.status != "read":
        block.diagnostics = int(block.status != "none")
        return block
    source = text[block.start : block.stop]
    try:
        if not source.strip():
            block.value = {}
            return block
        node = yaml.compose(source, Loader=_LOADER)
        if node is None:
            block.value = {}
            return block
        if not isinstance(node, yaml.MappingNode):
            raise Refused("not a mapping")
        reader = _Reader()
        block.value = reader.read(node)
        block.diagnostics = reader.diagnostics
        for key, value in node.value:
            items = value.value if isinstance(value, yaml.SequenceNode) else [value]
            for item in items:
                if isinstance(item, yaml.ScalarNode) and isinstance(reader.scalar(item), str):
                    block.strings.append((key.value, item.value, block.start + item.start_mark.index, block.start + item.end_mark.index, isinstance(value, yaml.SequenceNode)))
    except (Refused, yaml.YAMLError, RecursionError, ValueError):
        block.status, block.value, block.strings, block.diagnostics = "unreadable", None, [], 1
    return block


def _number(x: float) -> str:
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    text = format(Decimal(repr(x)), "f")
    return text if "." in text else text + ".0"


def canonical(value) -> str:
    """Canonical JSON: keys sorted by their bytes, integral floats keep `.0`, no exponents, least escaping."""
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def fields(text: str) -> list[tuple[str, int, int, str]]:
    """(field, start, stop, style) of each top-level field of a block that reads, in order; offsets in characters of its value. Styles: plain,
    single, double, literal, folded, flow-sequence, block-sequence, flow-map, block-map, empty."""
    block = read(text)
    if block.value is None or not text[block.start : block.stop].strip():
        return []
    out = []
    root = yaml.compose(text[block.start : block.stop], Loader=_LOADER)
    for key, value in root.value if root is not None else ():
        if isinstance(value, yaml.ScalarNode):
            style = {"'": "single", '"': "double", "|": "literal", ">": "folded"}.get(value.style or "", "plain" if value.value else "empty")
        else:
            style = ("flow-" if value.flow_style else "block-") + ("sequence" if isinstance(value, yaml.SequenceNode) else "map")
        out.append((str(key.value), block.start + value.start_mark.index, block.start + value.end_mark.index, style))
    return out


def entries(text: str) -> list[tuple[str, int, int]]:
    """(field, start, stop) of the whole lines of each top-level field of a block that reads; a field that shares a line with another, as in
    a flow mapping, has none. Comments and blank lines around a field aren't its own."""
    block = read(text)
    source = text[block.start : block.stop]
    if block.value is None or not source.strip():
        return []
    root = yaml.compose(source, Loader=_LOADER)
    if root is None or root.flow_style:
        return []
    out = []
    for key, value in root.value:
        a = max(source.rfind("\n", 0, key.start_mark.index), source.rfind("\r", 0, key.start_mark.index)) + 1
        last = max(key.end_mark.index, len(source[: value.end_mark.index].rstrip()))
        b = next((m.end() for m in re.compile(r"\r\n|\n|\r").finditer(source, last)), len(source))
        out.append((str(key.value), block.start + a, block.start + b))
    return out
