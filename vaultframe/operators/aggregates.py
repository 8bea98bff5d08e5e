"""Counting and describing frontmatter without a field-per-row table: fields are read from the JSON column as it is scanned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultframe.operators import predicates as P

MISSING = "(missing)"


def by_field(field: str) -> Column:
    return F.coalesce(P.raw(field), F.lit(MISSING)).alias(field)


def count_by(documents: DataFrame, *fields: str) -> DataFrame:
    """One row for each combination of values; absent and null count as '(missing)'. Partial counts before the one shuffle."""
    return documents.groupBy(*[by_field(f) for f in fields]).agg(F.count(F.lit(1)).alias("documents"))


def fields(documents: DataFrame) -> DataFrame:
    """(path, field, value): every top-level frontmatter field with its text, null values kept as null."""
    keys = documents.filter("frontmatter is not null").select("path", "frontmatter", F.explode(F.json_object_keys("frontmatter")).alias("field"))
    plain = F.expr("get_json_object(frontmatter, concat(\"$['\", field, \"']\"))")
    value = F.when(F.col("field").rlike("['?*]"), F.try_element_at(F.from_json("frontmatter", "map<string,string>"), "field")).otherwise(plain)
    return keys.select("path", "field", value.alias("value"))


def distribution(documents: DataFrame) -> DataFrame:
    """(field, value, documents) over all fields."""
    return fields(documents).groupBy("field", "value").agg(F.count(F.lit(1)).alias("documents"))


def describe(documents: DataFrame) -> DataFrame:
    """(field, present, distinct_values, unique_like, first_date, last_date): `unique_like` fields are those whose distribution says nothing."""
    day = F.try_to_date(F.nullif(F.regexp_extract(F.coalesce("value", F.lit("")), r"^(\d{4}-\d{2}-\d{2})(?:$|[T ])", 1), F.lit("")), "yyyy-MM-dd")
    return (
        fields(documents)
        .groupBy("field")
        .agg(F.count("value").alias("present"), F.count_distinct("value").alias("distinct_values"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))
        .withColumn("unique_like", (F.col("present") > 0) & (F.col("present") == F.col("distinct_values")))
    )


def structure(documents: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(facet, name, documents): how many documents lie under each folder, at any depth, match each rule's glob ('rule'), match none ('unruled'),
    and are there in all ('total'). One pass, one shuffle."""
    segs = F.split("path", "/")
    above = F.transform(F.filter(F.sequence(F.lit(0), F.size(segs) - 1), lambda n: n > 0), lambda n: F.struct(F.lit("folder").alias("facet"), F.concat_ws("/", F.slice(segs, 1, n)).alias("name")))
    hits = {n: F.coalesce(P.path_glob(g), F.lit(False)) for n, g in (rules or {}).items()}
    ruled = F.filter(F.array(*[F.struct(F.lit("rule").alias("facet"), F.when(h, F.lit(n)).alias("name")) for n, h in hits.items()]) if hits else above, lambda x: (x["facet"] == "rule") & x["name"].isNotNull())
    none = F.array(F.struct(F.lit("unruled").alias("facet"), F.when(F.size(ruled) == 0, F.lit("")).alias("name")), F.struct(F.lit("total").alias("facet"), F.lit("").alias("name")))
    all_ = F.filter(F.concat(above, ruled, none), lambda x: x["name"].isNotNull())
    return documents.select(F.explode(all_).alias("f")).groupBy("f.facet", "f.name").agg(F.count(F.lit(1)).alias("documents"))
