"""Results as text: the output formats of the query surface, as one string column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame) -> DataFrame:
    """(line): a JSON object a row, null fields left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))


def paths_only(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").alias("line"))


def records(df: DataFrame) -> DataFrame:
    """(line): `path` and then `field: value` of each field that is there."""
    rest = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {c}: "), F.col(c).cast("string"))) for c in df.columns if c != "path"]
    return df.select(F.concat_ws("\n", "path", *rest).alias("line"))


def markdown(df: DataFrame) -> DataFrame:
    """(line): a table row for each row, bars in values escaped."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def json_array(df: DataFrame) -> DataFrame:
    """(line): the rows as one JSON document, a line for each element with its comma, between brackets. The first and the last line are the
    array's; order is that of `df`'s first column, whose values are distinct. One aggregate tells which is the last, before any line is made."""
    first = df.columns[0]
    last = F.lit(df.agg(F.max(F.col(first))).first()[0])
    body = df.select(F.col(first).cast("string").alias("_at"), F.lit(1).alias("_part"), F.concat(F.to_json(F.struct(*df.columns)), F.when(F.col(first) == last, "").otherwise(",")).alias("line"))
    edges = df.sparkSession.createDataFrame([("", 0, "["), ("", 2, "]")], "_at string, _part int, line string")
    return edges.unionByName(body).orderBy("_part", "_at").select("line")


def report(df: DataFrame, title: str) -> DataFrame:
    """(line): a summary (name, count) as text: a head line with the total, then a line a name, largest first, counts right-aligned in eight places."""
    total = df.agg(F.lit(0).alias("_part"), F.lit(0).cast("bigint").alias("_n"), F.lit("").alias("_name"), F.concat(F.lit(title + ": "), F.coalesce(F.sum("count"), F.lit(0)).cast("string")).alias("line"))
    rows = df.select(F.lit(1).alias("_part"), F.col("count").cast("bigint").alias("_n"), F.col("name").alias("_name"), F.concat(F.lpad(F.col("count").cast("string"), 8, " "), F.lit("  "), "name").alias("line"))
    return total.unionByName(rows).orderBy("_part", F.desc("_n"), "_name").select("line")
