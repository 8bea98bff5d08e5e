"""Queries of a store that was filled with every document and then changed (inventory I, T2, M), with the SQL that must agree.

The changeset writes every fiftieth document anew with one link and a few words, and kills every fiftieth of others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vaultframe.functions import parse
from vaultframe.operators import fulltext, store
from vaultframe.queries.states import _ALL, _AS_RECORDS, _records
from vaultframe.session import folder, materialize, table

NEW = "# Anew\n\n[[planted|shown]] moss moss #swept\n"


def _changes(docs, text):
    """Upserts of documents with a text, with all their facts."""
    texts = docs.select("doc_id", "path", F.lit(0).alias("seq"), text.alias("text"))
    parsed = parse.parse(texts, "doc_id", "text").join(texts, "doc_id")
    return parsed.select(
        "seq", F.lit("upsert").alias("kind"), "path", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("bigint").alias("byte_length"), "body", F.sha2("body", 256).alias("body_hash"), "body_offset",
        "frontmatter", F.sha2("frontmatter", 256).alias("frontmatter_projection_hash"), "frontmatter_diagnostic_count", F.lit(None).cast("string").alias("provenance"), *store.FACTS,
    )


def _store(spark, sf, with_findings=False, indexed=False):
    docs = table(spark, sf, "documents").filter("text is not null")
    held = store.Store(spark, folder(spark, "store"), buckets=8, indexed=indexed)
    held.apply(_changes(docs, F.col("text")), 1)
    if with_findings:
        held.record(_records(spark, sf))
    deaths = docs.filter("pmod(doc_id, 50) = 9").select(F.lit(1).alias("seq"), F.lit("death").alias("kind"), "path", F.lit("watcher-removal").alias("provenance"))
    held.apply(_changes(docs.filter("pmod(doc_id, 50) = 7"), F.lit(NEW)).unionByName(deaths, allowMissingColumns=True), 2)
    return held


def i01_applied(spark, sf):
    """Documents and deaths as they stand after both changesets."""
    held = _store(spark, sf)
    live = held.read("documents").select("path", "generation", F.lit("document").alias("kind"), "content_hash")
    dead = held.read("tombstones").select("path", "generation", F.lit("death").alias("kind"), F.col("last_content_hash").alias("content_hash"))
    return live.unionByName(dead)


def i02_facts(spark, sf):
    """Links, headings and tags as they stand."""
    held = _store(spark, sf)
    parts = [held.read(t).select("path", F.lit(t).alias("fact"), "ordinal", F.col(c).alias("value")) for t, c in (("links", "target"), ("headings", "slug"), ("tags", "name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def i05_standing(spark, sf):
    """Findings that stand: those of changed paths are gone, and those of link targets whose class a changed path is in."""
    return _store(spark, sf, with_findings=True).read("findings").select("id", "kind", "path", "message", "generation")


def i13_counters(spark, sf):
    """What the second changeset counted."""
    held = _store(spark, sf)
    return spark.createDataFrame(sorted(held.counters.items()), "counter string, n bigint").filter("n > 0")


def t02_postings(spark, sf):
    """The stored index's vocabulary after both changesets, kept and not derived anew."""
    return fulltext.vocabulary(_store(spark, sf, indexed=True).read("postings"))


def t03_stored_drift(spark, sf):
    """The stored index against one derived from the stored bodies, after a twentieth of it was lost."""
    held = _store(spark, sf, indexed=True)
    kept = materialize(held.read("postings").filter("pmod(length(path) + length(term), 20) <> 0"), "kept")
    derived = fulltext.postings(held.read("documents"), "path", "body").select("term", F.col("doc").alias("path"), "positions")
    return fulltext.drift(kept, derived)


def m09_feed(spark, sf):
    """Everything the feed has after the first changeset's position."""
    from vaultframe.streaming import watch

    held = _store(spark, sf)
    watch.register(spark)
    stream = spark.readStream.format("vault_feed").option("path", held.base).load()
    to, at = folder(spark, "feed"), folder(spark, "feed-checkpoint")
    stream.writeStream.format("parquet").option("path", to).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("generation bigint, path string, kind string, content_hash string").parquet(to)


_TEXT = "'" + NEW.replace("\n", "' || chr(10) || '") + "'"
_LIVE = "live AS (SELECT * FROM documents WHERE text IS NOT NULL AND doc_id % 50 <> 9)"
_STANDS = f"SELECT path, CASE WHEN doc_id % 50 = 7 THEN 2 ELSE 1 END AS generation, 'document' AS kind, CASE WHEN doc_id % 50 = 7 THEN sha256({_TEXT}) ELSE content_hash END AS content_hash FROM live UNION ALL SELECT path, 2, 'death', content_hash FROM documents WHERE text IS NOT NULL AND doc_id % 50 = 9"
_TERM = f"terms AS (SELECT doc_id, path, unnest(regexp_extract_all(strip_accents(lower(CASE WHEN doc_id % 50 = 7 THEN {_TEXT} ELSE body END)), '[\\p{{L}}\\p{{N}}]+')) AS term FROM live)"


def _fact(name: str, table_: str, column: str) -> str:
    return f"SELECT path, '{name}' AS fact, ordinal, {column} AS value FROM (SELECT DISTINCT document, ordinal, {column} FROM {table_}) f JOIN live d ON d.doc_id = f.document WHERE doc_id % 50 <> 7"


ORACLES = {
    "i01_applied": f"WITH {_LIVE} {_STANDS}",
    "m09_feed": f"WITH {_LIVE} {_STANDS}",
    "i02_facts": f"WITH {_LIVE} {_fact('links', 'links', 'target')} UNION ALL {_fact('headings', 'headings', 'slug')} UNION ALL {_fact('tags', 'document_tags', 'name')} UNION ALL SELECT path, unnest(['links', 'headings', 'tags']), 0, unnest(['planted', 'anew', 'swept']) FROM live WHERE doc_id % 50 = 7",
    "i05_standing": f"""
WITH {_ALL}, {_AS_RECORDS}, moved AS (SELECT path, string_split(suffix_key, '/')[1] || '/' AS key FROM documents WHERE text IS NOT NULL AND doc_id % 50 IN (7, 9)), each AS (SELECT id, unnest(string_split(class_keys, '|')) AS key FROM records)
SELECT id, kind, path, message, 1 AS generation FROM records WHERE path NOT IN (SELECT path FROM moved) AND id NOT IN (SELECT id FROM each WHERE key IN (SELECT key FROM moved))""",
    "i13_counters": """
WITH t AS (SELECT doc_id FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id FROM t WHERE doc_id % 50 IN (7, 9)), up AS (SELECT count(*) AS n FROM t WHERE doc_id % 50 = 7), dead AS (SELECT count(*) AS n FROM t WHERE doc_id % 50 = 9),
f AS (SELECT DISTINCT 'l', document, ordinal FROM links UNION ALL SELECT DISTINCT 'h', document, ordinal FROM headings UNION ALL SELECT DISTINCT 't', document, ordinal FROM document_tags)
SELECT * FROM (SELECT unnest(['documents_upserted', 'link_rows_written', 'heading_rows_written', 'tag_rows_written']) AS counter, n FROM up UNION ALL SELECT unnest(['documents_deleted', 'tombstones_recorded']), n FROM dead UNION ALL SELECT 'fact_rows_discarded', count(*) FROM f WHERE document IN (SELECT doc_id FROM d)) WHERE n > 0""",
    "t02_postings": f"WITH {_LIVE}, {_TERM} SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM terms GROUP BY 1",
    "t03_stored_drift": f"WITH {_LIVE}, {_TERM} SELECT 'stored' AS side, 0::BIGINT AS rows UNION ALL SELECT 'derived', count(*) FROM (SELECT DISTINCT path, term FROM terms) WHERE (length(path) + length(term)) % 20 = 0",
}

QUERIES = {k: globals()[k] for k in ORACLES}
