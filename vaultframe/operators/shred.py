"""Columnar shredding of nested JSON records and reconstruction of flat tables (problem 1).

`shred` stripes each record into one row per leaf path: the values of that path in record order, with a repetition level
(which repeated ancestor starts anew) and a definition level (how far along the path the record goes) for each. `objects`
and `cells` rebuild rows of any repeated ancestor from those level sequences alone; the JSON isn't read again.

A path is its steps, each after a '/': a field is its name escaped as in a JSON Pointer (~0, ~1), an array item is '~'
(no escaped name is a lone '~'). The record's own path is ''. Step k (from 0) adds two to the definition level: 2k + 1 when the value at depth k has the kind
the step needs (object or array), 2k + 2 when the field or item is there. A leaf adds one more. `kind` tells leaves apart: 'value'
(a scalar, null included), 'object' (an empty object), 'array' (an empty array).
`fresh` is the least depth whose objects no earlier path of the record covers: each object belongs to exactly one path, so
rebuilding objects needs no distinct and no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.session import slices, spread

ITEM = "~"
LEVELS = "{key} {key_type}, path string, kind string, fresh int, repetition array<int>, definition array<int>, value array<string>"
_MISSING = object()
#: Bytes of JSON that a task has shredded rows of at once; a longer record is alone.
CHUNK_BYTES = 2_000_000


class _Scalar(str):
    """A number's own spelling, so that 1.0 stays 1.0."""


class _Node:
    __slots__ = ("fields", "is_object", "is_array", "item", "is_value", "has_empty_object", "has_empty_array", "object_leaf", "array_leaf", "value_leaf")

    def __init__(self) -> None:
        self.fields: dict[str, _Node] = {}
        self.item: _Node | None = None
        self.is_object = self.is_array = self.is_value = self.has_empty_object = self.has_empty_array = False
        self.object_leaf = self.array_leaf = self.value_leaf = None


def escape(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


# All walks below keep their own stacks, so that a record may be as deep as it likes.

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}


def _key(text: str, i: int) -> tuple[str, int]:
    if text[i : i + 1] != '"':
        raise ValueError("a name is missing")
    name, i = scanstring(text, i + 1, True)
    i = _SPACE.match(text, i).end()
    if text[i : i + 1] != ":":
        raise ValueError("a colon is missing")
    return name, _SPACE.match(text, i + 1).end()


def _deep_loads(text: str):
    """What json.loads gives, for records nested more deeply than it can go."""
    boxes, keys = [], []
    i = _SPACE.match(text, 0).end()
    while True:
        c = text[i : i + 1]
        if c and c in "{[":
            box: dict | list = {} if c == "{" else []
            i = _SPACE.match(text, i + 1).end()
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                boxes.append(box)
                if c == "{":
                    name, i = _key(text, i)
                    keys.append(name)
                continue
            value, i = box, i + 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif number := _NUMBER.match(text, i):
            value, i = _Scalar(number.group()), number.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, i)), None)
            if word is None:
                raise ValueError("no JSON")
            value, i = _WORDS[word], i + len(word)
        while True:  # the value's place; and that of the box it closes, and so on
            i = _SPACE.match(text, i).end()
            if not boxes:
                if i < len(text):
                    raise ValueError("more than one value")
                return value
            box = boxes[-1]
            if isinstance(box, dict):
                box[keys.pop()] = value
            else:
                box.append(value)
            c = text[i : i + 1]
            if c == ",":
                i = _SPACE.match(text, i + 1).end()
                if isinstance(box, dict):
                    name, i = _key(text, i)
                    keys.append(name)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("a box is open")
            value, i = boxes.pop(), i + 1


def _learn(root: _Node, record) -> None:
    """The record's own schema: which kinds each place takes."""
    todo = [(root, record)]
    while todo:
        node, x = todo.pop()
        if isinstance(x, dict):
            node.is_object = True
            node.has_empty_object |= not x
            for k in x:
                if k not in node.fields:
                    node.fields[k] = _Node()
            todo += [(node.fields[k], v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            node.is_array = True
            node.has_empty_array |= not x
            if x and node.item is None:
                node.item = _Node()
            todo += [(node.item, v) for v in reversed(x)]
        else:
            node.is_value = True


def _leaves(root: _Node) -> list:
    """Gives each leaf its column, depth first, so that a place's columns stand together. A step is linked to the one above it."""
    out: list = []

    def leaf(kind: str, step: tuple | None) -> tuple:
        steps = []
        while step:
            steps.append(step[1])
            step = step[0]
        out.append((tuple(reversed(steps)), kind, [], [], []))
        return out[-1]

    todo: list = [(root, None, None)]
    while todo:
        node, step, kind = todo.pop()
        if kind == "object":
            node.object_leaf = leaf(kind, step)
        elif kind == "array":
            node.array_leaf = leaf(kind, step)
        elif kind == "value":
            node.value_leaf = leaf(kind, step)
        else:
            if node.is_value:
                todo.append((node, step, "value"))
            if node.has_empty_array:
                todo.append((node, step, "array"))
            if node.item is not None:
                todo.append((node.item, (step, ITEM), None))
            if node.has_empty_object:  # after the fields, which own the objects here
                todo.append((node, step, "object"))
            todo += [(child, (step, escape(k)), None) for k, child in reversed(node.fields.items())]
    return out


def _put(leaf: tuple, r: int, d: int, value: str | None = None) -> None:
    leaf[2].append(r)
    leaf[3].append(d)
    leaf[4].append(value)


def _stripe(root: _Node, record) -> None:
    """Puts the record's values and levels in its leaves' columns, in record order."""
    todo = [(root, record, 0, 0, 0)]
    while todo:
        node, x, r, d, arrays = todo.pop()
        if node.is_object:
            there = isinstance(x, dict)
            if node.object_leaf:
                _put(node.object_leaf, r, d + (there and not x))
            for k, child in node.fields.items():
                v = x.get(k, _MISSING) if there else _MISSING
                todo.append((child, v, r, d + (0 if not there else 1 if v is _MISSING else 2), arrays if there else 0))
        if node.is_array:
            there = isinstance(x, list)
            if node.array_leaf:
                _put(node.array_leaf, r, d + (there and not x))
            if node.item is not None and (not there or not x):
                todo.append((node.item, _MISSING, r, d + there, 0))
            elif node.item is not None:
                todo += [(node.item, x[i], r if i == 0 else arrays + 1, d + 2, arrays + 1) for i in range(len(x) - 1, -1, -1)]
        if node.is_value:
            if x is _MISSING or isinstance(x, (dict, list)):
                _put(node.value_leaf, r, d)
            else:
                _put(node.value_leaf, r, d + 1, str(x) if isinstance(x, _Scalar) else json.dumps(x, ensure_ascii=False))


def shred_record(text: str | None) -> list[tuple[str, str, int, list[int], list[int], list[str | None]]]:
    """(path, kind, fresh, repetition, definition, value) of each leaf path. No rows for null, blank or unreadable text; a record of any depth
    is read."""
    if text is None:
        return []
    try:
        record = json.loads(text, parse_float=_Scalar, parse_int=_Scalar)
    except RecursionError:
        try:
            record = _deep_loads(text)
        except ValueError:
            return []
    except ValueError:
        return []
    root = _Node()
    _learn(root, record)
    leaves = _leaves(root)
    _stripe(root, record)
    out, before = [], ()
    for steps, kind, rep, dfn, values in leaves:
        shared = 0
        for a, b in zip(before, steps):
            if a != b:
                break
            shared += 1
        covered = [s for s in range(shared + 1) if s < len(before) and before[s] != ITEM]
        out.append(("".join(f"/{s}" for s in steps), kind, covered[-1] + 1 if covered else 0, rep, dfn, values))
        before = steps
    return out


def _utf8(s: str | None) -> str | None:
    """Lone surrogates, which JSON can spell and UTF-8 can't, become U+FFFD."""
    if s is None or s.isascii():
        return s
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def shred(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each record's leaf path: (key, path, kind, fresh, repetition, definition, value).

    Narrow: no shuffle, one Arrow pass, only `key` and `column` are read. Null, empty and unreadable records give no rows; a record
    that is a bare scalar has the one path ''. Repeated rows give repeated results. Other columns of df are ignored, whatever
    their names. A very long record costs its own size. An empty df gives an empty result."""
    schema = LEVELS.format(key="record", key_type=dict(df.dtypes)[key])

    def stripe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, CHUNK_BYTES):
            rows, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = shred_record(text)
                rows += found
                at += [i] * len(found)
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array([_utf8(x) for x in cols[0]], pa.string()),
                    pa.array(cols[1], pa.string()),
                    pa.array(cols[2], pa.int32()),
                    pa.array(cols[3], pa.list_(pa.int32())),
                    pa.array(cols[4], pa.list_(pa.int32())),
                    pa.array([[_utf8(v) for v in vs] for vs in cols[5]], pa.list_(pa.string())),
                ],
                names=["record", "path", "kind", "fresh", "repetition", "definition", "value"],
            )

    return spread(df.select(F.col(key).alias("record"), F.col(column).alias("text"))).mapInArrow(stripe, schema)


def _positions(steps: list[str], repetition: list[int]) -> Iterator[list[int]]:
    """For each entry of a path the array positions of its repeated ancestors, from the repetition levels alone."""
    at = [0] * (sum(s == ITEM for s in steps) + 1)
    first = True
    for r in repetition:
        if r:
            at[r] += 1
        if r or not first:
            for k in range(r + 1, len(at)):
                at[k] = 0
        first = False
        yield at


def record_objects(path: str, kind: str, fresh: int, repetition: list[int], definition: list[int]) -> list[tuple[str, str]]:
    """(node, parent) of the objects below the root that this path owns: those from depth `fresh` on."""
    steps = path.split("/")[1:]
    depths = [s for s in range(max(1, fresh), len(steps)) if steps[s] != ITEM]
    if kind == "object" and len(steps) >= max(1, fresh):
        depths.append(len(steps))
    if not depths:
        return []
    arrays = [0]
    for s in steps:
        arrays.append(arrays[-1] + (s == ITEM))
    above = {}
    for s in depths:
        above[s] = next((u for u in range(s - 1, -1, -1) if steps[u] != ITEM), 0)
    out = []
    for (r, d), at in zip(zip(repetition, definition), _positions(steps, repetition)):
        for s in depths:
            if d < 2 * s + 1:
                break
            if r <= arrays[s]:
                parts, k = [], 0
                for step in steps[:s]:
                    if step == ITEM:
                        k += 1
                        parts.append(f"/{at[k]}")
                    else:
                        parts.append("/" + step)
                out.append(("".join(parts), "".join(parts[: above[s]])))
    return out


def objects(levels: DataFrame) -> DataFrame:
    """(record, node, parent): every JSON object below each record's root, rebuilt from the level sequences. `node` is the JSON
    Pointer, `parent` that of the nearest enclosing object ('' for the root or where none encloses it). No shuffle."""
    schema = f"record {dict(levels.dtypes)['record']}, node string, parent string"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nodes = [], []
            for i, x in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 6)))):
                found = record_objects(*x)
                nodes += found
                at += [i] * len(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([n for n, _ in nodes], pa.string()), pa.array([p for _, p in nodes], pa.string())],
                names=["record", "node", "parent"],
            )

    return levels.select("record", "path", "kind", "fresh", "repetition", "definition").mapInArrow(rebuild, schema)


def record_cells(path: str, kind: str, repetition: list[int], definition: list[int], value: list[str | None]) -> list[tuple]:
    """(table, node, parent, parent_table, column, value): each present value as a cell of its nearest repeated ancestor's table."""
    steps = path.split("/")[1:]
    cuts = [0] + [i + 1 for i, s in enumerate(steps) if s == ITEM]
    own, up = cuts[-1], cuts[-2] if len(cuts) > 1 else 0
    full = 2 * len(steps) + 1
    column = "/".join(steps[own:])
    named, above = "".join(f"/{s}" for s in steps[:own]), "".join(f"/{s}" for s in steps[:up])
    out = []
    for d, v, at in zip(definition, value, _positions(steps, repetition)):
        if d == full:
            parts, k = [], 0
            for step in steps[:own]:
                k += step == ITEM
                parts.append(f"/{at[k]}" if step == ITEM else "/" + step)
            out.append((named, "".join(parts), "".join(parts[:up]), above, column, v if kind == "value" else "{}" if kind == "object" else "[]"))
    return out


def cells(levels: DataFrame) -> DataFrame:
    """(record, table, node, parent, parent_table, column, value): the flat tables in long form. `table` is the path of a repeated ancestor
    ('' for the record itself), `node` the pointer of one of its rows, `parent` the row of `parent_table` that holds it; `column` is
    the rest of the path and `value` JSON text. Fields of nested objects are columns of the row around them. No shuffle."""
    schema = f"record {dict(levels.dtypes)['record']}, `table` string, node string, parent string, parent_table string, `column` string, value string"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, x in enumerate(zip(*(batch.column(k).to_pylist() for k in range(1, 6)))):
                found = record_cells(*x)
                rows += found
                at += [i] * len(found)
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in cols)],
                names=["record", "table", "node", "parent", "parent_table", "column", "value"],
            )

    return levels.select("record", "path", "kind", "repetition", "definition", "value").mapInArrow(rebuild, schema)


def flat_table(cell: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One wide table of `cells`: (record, node, parent, one column for each of `columns`). Rows without any of them stay, by their other cells.
    One shuffle on (record, node), aggregated before it; a record's rows are spread by node, so a huge record isn't one task's."""
    picked = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(c.replace("/", "_")) for c in columns]
    return cell.filter(F.col("table") == name).groupBy("record", "node", "parent").agg(*picked)
