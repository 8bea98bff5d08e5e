"""What becomes of a file that is read: a row, a degraded row, or a quarantine that drops the row at its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.operators import paths

#: Kinds of finding: of a place, withheld while a document stands there; and of a document, which stays.
PLACE_KINDS = ["document/path-refused", "document/path-not-utf8", "document/not-utf8"]
DOCUMENT_KINDS = ["document/frontmatter-unclosed", "document/frontmatter-too-large", "document/frontmatter-unreadable"]


def kind(path: Column, text: Column, status: Column, path_is_utf8: Column | None = None) -> Column:
    """The finding of one read file, or null. The path is judged before the content, its bytes before its spelling."""
    return (
        F.when(F.lit(False) if path_is_utf8 is None else ~path_is_utf8, PLACE_KINDS[1])
        .when(paths.refusal(path).isNotNull(), PLACE_KINDS[0])
        .when(text.isNull(), PLACE_KINDS[2])
        .when(status == "unclosed", DOCUMENT_KINDS[0])
        .when(status == "too-large", DOCUMENT_KINDS[1])
        .when(status == "unreadable", DOCUMENT_KINDS[2])
    )


def drops_row(found: Column) -> Column:
    return found.isin(PLACE_KINDS)


def quarantine_changes(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Deaths of standing rows at quarantined places: (path, seq, kind, provenance)."""
    bad = found.filter(drops_row(F.col("finding"))).select("path").distinct()
    return documents.join(bad, "path", "left_semi").select("path", F.lit(0).alias("seq"), F.lit("death").alias("kind"), F.lit("quarantine").alias("provenance"))


def rendered(path: Column) -> Column:
    """A path spelling as a place that can be named: itself if it isn't refused; else control characters and backslashes become U+FFFD and
    empty, `.` and `..` segments are marked, and if the leaf is refused still, the leaf is marked. Total."""
    text = F.coalesce(path, F.lit(""))
    segs = F.split(F.regexp_replace(text, paths.CONTROL + r"|\\", "\ufffd"), "/", -1)
    marked = F.concat_ws("/", F.transform(segs, lambda s: F.when(s.isin("", ".", ".."), F.concat(F.lit("\ufffd"), s)).otherwise(s)))
    return F.when(paths.refusal(text).isNull(), text).when(paths.refusal(marked).isNull(), marked).otherwise(F.regexp_replace(marked, "(?s)^(.*/)?([^/]*)$", "$1\ufffd$2"))


def unexplained(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Documents whose frontmatter was not read and that no standing finding of a document kind explains: they are to be derived again."""
    standing = findings.filter(F.col("kind").isin(DOCUMENT_KINDS)).select("path")
    return documents.filter("frontmatter is null and frontmatter_diagnostic_count > 0").join(standing, "path", "left_anti")
