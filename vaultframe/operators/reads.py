"""Store reads: point lookups, keyset pages, feeds and set probes over the vault's tables. All declarative; filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultframe.operators import paths

PAGE_MAX = 1024


def _limit(n: int) -> int:
    if not 1 <= n <= PAGE_MAX:
        raise ValueError(f"a page holds 1 to {PAGE_MAX} rows")
    return n


def page(df: DataFrame, key: str, after: str | None, n: int) -> DataFrame:
    """The n rows after a cursor in byte order of `key`; the cursor is the scan's floor, no row before it is read."""
    return df.filter(F.col(key) > F.lit(after or "")).orderBy(key).limit(_limit(n))


def subtree_page(df: DataFrame, root: str, itself: bool, after: str | None, n: int) -> DataFrame:
    """As `page`, of a folder's documents; segment-safe: a/b never takes a/bc."""
    return page(df.filter(paths.under(F.col("path"), root, itself)), "path", after, n)


def folded_page(df: DataFrame, after: str | None, n: int) -> DataFrame:
    """As `page`, in the order of a vault that folds ASCII case: by the folded path, then the path."""
    folded = paths.ascii_fold(F.col("path"))
    floor, least = paths.ascii_fold(F.lit(after or "")), F.lit(after or "")
    past = (folded >= floor) & ((folded > floor) | (F.col("path") > least))
    return df.filter(past).orderBy(folded, "path").limit(_limit(n))


def after_position(generation: int, path: str) -> Column:
    """Rows past a feed cursor, spelled so that Parquet prunes by it."""
    g, p = F.col("generation"), F.col("path")
    return (g >= generation) & ((g > generation) | ((g == generation) & (p > path)))


def feed(df: DataFrame, columns: list[str], generation: int, path: str, n: int) -> DataFrame:
    return df.filter(after_position(generation, path)).select("generation", "path", *columns).orderBy("generation", "path").limit(_limit(n))


def merged_feed(documents: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(generation, path, kind, content_hash): living rows and deaths; at one position a document outranks a death."""
    live = documents.select("generation", "path", F.lit("document").alias("kind"), "content_hash")
    dead = tombstones.select("generation", "path", F.lit("death").alias("kind"), F.col("last_content_hash").alias("content_hash"))
    first = Window.partitionBy("generation", "path").orderBy(F.desc("kind"))
    return live.unionByName(dead).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def pillar_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(pillar, rows) of each table; each count reads no column."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("pillar"), "rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def suffix_candidates(documents: DataFrame, target: str) -> DataFrame:
    """The documents one suffix target names: one or two prefix ranges over suffix_key, pushed down, in ladder order."""
    forms = {target}
    head, _, leaf = target.rpartition("/")
    if "." in leaf[1:]:
        forms.add((head + "/" if head else "") + leaf[: leaf.rindex(".")])
    hit = F.lit(False)
    for form in sorted(forms):
        probe = "/".join(reversed(form.split("/"))) + "/"
        hit = hit | F.col("suffix_key").startswith(probe)
    return documents.filter(hit).orderBy("suffix_key", "path")


def newest(df: DataFrame, *keys: str) -> DataFrame:
    """Rows without their late repeats: one for each key, the greatest of those that differ, so that any run keeps the same."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_.{c}").alias(c) for c in df.columns])


def section_bounds(headings: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, ordinal, text, start, stop): each heading's section in bytes of the body: to the next heading of the same or a higher level, or
    the body's end. A window over one document's headings each."""
    h = newest(headings, "document", "ordinal")
    later = Window.partitionBy("document").orderBy("ordinal").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= n, F.col("span_offset"))).over(later).alias(f"e{n}") for n in range(1, 7)]
    pick = F.coalesce(*[F.when(F.col("level") == n, F.col(f"e{n}")) for n in range(1, 7)])
    docs = documents.select(F.col("doc_id").alias("document"), (F.col("byte_length") - F.col("body_offset")).alias("size"))
    return h.select("document", "ordinal", "text", "level", F.col("body_offset").alias("start"), *ends).join(docs, "document").select("document", "ordinal", "text", "start", F.coalesce(pick, F.col("size")).alias("stop"))


def finding_subjects(findings: DataFrame, documents: DataFrame, kinds: list[str], after: str | None, n: int) -> DataFrame:
    """(path): the first n paths after a cursor with a finding of `kinds` and no document."""
    return page(findings.filter(F.col("kind").isin(kinds)).select("path").join(documents.select("path"), "path", "left_anti").distinct(), "path", after, n)


def findings_for_path(findings: DataFrame, path: str) -> DataFrame:
    """A path's findings with their candidates, oldest first."""
    return findings.filter(F.col("path") == path).orderBy("generation", "id")


def finding_page(findings: DataFrame, after: str | None, n: int) -> DataFrame:
    """The n findings after an id."""
    past = findings if after is None else findings.filter(F.col("id") > after)
    return past.orderBy("id").limit(_limit(n))


def in_class(findings: DataFrame, class_key: str) -> DataFrame:
    """Findings of an ambiguity class, each once: some class key of theirs is it or lies under it."""
    return findings.filter(F.exists("class_keys", lambda k: k.startswith(class_key))).orderBy("id")


def drain(df: DataFrame, key: str, n: int):
    """All rows as keyset pages, each a list of rows: a page's last key is the next one's floor."""
    after: str | None = None
    while True:
        rows = page(df, key, after, n).collect()
        if rows:
            yield rows
        if len(rows) < n:
            return
        after = rows[-1][key]
