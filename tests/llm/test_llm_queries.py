"""The subpackage's queries with SQL against that SQL, and the shape the driver expects of the others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.compare import differences
from tests.conftest import SF
from vaultframe.llm import queries, sql
from vaultframe.session import table

COLUMNS = {
    "p2_found": {"model_id", "dimensions", "doc_a", "doc_b"}, "p3_found": {"tag_a", "tag_b"}, "p4_found": {"doc_id", "block_offset"},
    "p6_found": {"doc_a", "doc_b"}, "p7_ids": {"doc_id", "ids"}, "p9_found": {"doc_id"},
}


@pytest.mark.parametrize("name", queries.ORACLES)
def test_agrees_with_sql(spark, name):
    said = differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)
    assert said in ("", "no rows") and (said == "" or name == "p3_found"), said


@pytest.mark.parametrize("name", queries.QUERIES)
def test_runs_whole(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert COLUMNS.get(name, set(df.columns)) == set(df.columns)
    assert df.count() >= 0


def test_surprise_has_every_pair_that_shares_a_document(spark):
    whole = sql._TAGS + " SELECT tag_a, tag_b, together, n_a, n_b, round(together * docs / (n_a * n_b), 6) AS lift FROM counted"
    got = queries.p3_surprise(spark, SF).select("tag_a", "tag_b", "together", "n_a", "n_b", F.round("lift", 6).alias("lift"))
    assert got.filter("together = 1").count() > 0
    assert differences(got, whole, SF) == ""


@pytest.mark.parametrize("name", ["p6_documents", "p6_strict_documents"])
def test_every_document_is_classed(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(got.columns) == {"doc_id", "class_id", "group_id", "links"}
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in table(spark, SF, "documents").select("doc_id").collect())


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for p in (root / "vaultframe").rglob("*.py"):
        assert "llm" in p.parts or "vaultframe.llm" not in p.read_text(), p
