"""The find and count surface: predicates over frontmatter, body and path as Column expressions, JVM-side.

`field` is a top-level frontmatter key, dots included. Decisions where the semantics leave a choice: a row without the field passes
not_eq and not_in; text predicates fail on values that aren't strings; dates that don't read fail.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

FRONTMATTER = "frontmatter"


def raw(field: str) -> Column:
    """The field's text: a string without quotes, anything else as JSON; null if absent or null. A name that a JSON path can't spell is looked up
    among all fields instead."""
    if set(field) & set("'?*"):
        return F.try_element_at(F.from_json(FRONTMATTER, "map<string,string>"), F.lit(field))
    return F.get_json_object(FRONTMATTER, f"$['{field}']")


def kind(field: str) -> Column:
    """The field's JSON type as Spark names it (STRING, BIGINT, BOOLEAN, ARRAY<..>); null if absent, VOID if null."""
    variant = F.try_variant_get(F.parse_json(F.col(FRONTMATTER)), "$['" + field.replace("'", "\\'") + "']", "variant")
    return F.schema_of_variant(variant)


def eq(field: str, value) -> Column:
    """JSON-typed equality: the string "1" isn't the number 1."""
    if isinstance(value, str):
        return F.coalesce((raw(field) == value) & (kind(field) == "STRING"), F.lit(False))
    return F.coalesce((raw(field) == json.dumps(value)) & (kind(field) != "STRING"), F.lit(False))


def not_eq(field: str, value) -> Column:
    return ~eq(field, value)


def any_of(field: str, values: list) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | eq(field, v)
    return out


def none_of(field: str, values: list) -> Column:
    return ~any_of(field, values)


def strings(field: str) -> Column:
    """The field's strings: itself, or the strings of its array; empty otherwise."""
    items = F.from_json(raw(field), "array<string>")
    return F.when(kind(field) == "STRING", F.array(raw(field))).when(kind(field).startswith("ARRAY"), items).otherwise(F.array().cast("array<string>"))


def _some(field: str, test) -> Column:
    return F.coalesce(F.exists(strings(field), lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def starts_with(field: str, text: str) -> Column:
    return _some(field, lambda x: x.startswith(text))


def ends_with(field: str, text: str) -> Column:
    return _some(field, lambda x: x.endswith(text))


def contains(field: str, text: str) -> Column:
    return _some(field, lambda x: x.contains(text))


def has(field: str) -> Column:
    return raw(field).isNotNull()


def missing(field: str) -> Column:
    return raw(field).isNull()


def date(field: str) -> Column:
    """The field as a date if it begins like an ISO one and reads, else null."""
    day = F.regexp_extract(F.coalesce(raw(field), F.lit("")), r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1)
    return F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd")


def before(field: str, day: str) -> Column:
    return F.coalesce(date(field) < F.to_date(F.lit(day)), F.lit(False))


def after(field: str, day: str) -> Column:
    return F.coalesce(date(field) > F.to_date(F.lit(day)), F.lit(False))


def on(field: str, day: str) -> Column:
    return F.coalesce(date(field) == F.to_date(F.lit(day)), F.lit(False))


def text(needle: str) -> Column:
    """Case-insensitive substring of the body; an empty needle passes all."""
    return F.lit(True) if not needle else F.coalesce(F.lower("body").contains(needle.lower()), F.lit(False))


def glob_regex(glob: str) -> str:
    """`*` within a segment, `**` across segments, `?` one character; anchored."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if glob[i] in r".^$+{}()|[]\\" else "") + glob[i], i + 1
    return "^" + out + "$"


def path_glob(glob: str) -> Column:
    return F.col("path").rlike("(?s)" + glob_regex(glob))
