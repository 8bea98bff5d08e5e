"""Every catalogue query with SQL against that SQL, and the plans of those that must not degrade."""

from __future__ import annotations

import importlib

import pytest

from tests.compare import differences
from tests.conftest import SF
from vaultframe.queries import CATALOG

MODULES = [importlib.import_module(m) for m in CATALOG]
CASES = [(name, m) for m in MODULES for name in m.ORACLES]
#: The smallest tables have no row for these.
MAY_BE_EMPTY = {"f17_combined", "l08_length", "l11_reference_type", "f02_eq_number", "f08_contains", "r04_under_page", "m09_batches", "r20_in_class", "i06_class_discard", "f13_on", "m04_quarantine", "r13_death_feed", "j06_stale_vectors", "parse03_refusals", "m03_rederive", "l12_unread", "l13_kinds", "r12_living_feed", "l14_triage", "i04_guard", "u01_union"}


@pytest.mark.parametrize("name,module", CASES, ids=[n for n, _ in CASES])
def test_agrees_with_sql(spark, name, module):
    said = differences(module.QUERIES[name](spark, SF), module.ORACLES[name], SF)
    assert said in ("", "no rows") and (said == "" or name in MAY_BE_EMPTY), said


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["x09_links_to", "x12_candidate_head", "x11_minimal_suffix", "f16_unresolved", "l04_ambiguous", "d09_move", "m01_heal", "r06_document_facts"])
def test_no_pairwise_joins(spark, name):
    module = next(m for n, m in CASES if n == name)
    text = plan(module.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name,pushed", [("r02_page", "GreaterThan(path"), ("r12_living_feed", "GreaterThanOrEqual(generation"), ("r19_suffix_candidates", "StringStartsWith(suffix_key"), ("r03_subtree_page", "LessThan(path")])
def test_filters_reach_the_scan(spark, name, pushed):
    module = next(m for n, m in CASES if n == name)
    text = plan(module.QUERIES[name](spark, SF))
    assert pushed in text and "body:string" not in text.split("Physical Plan")[-1]
    assert name == "r19_suffix_candidates" or "TakeOrderedAndProject" in text


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["missing_in", "month", "orphans"]
