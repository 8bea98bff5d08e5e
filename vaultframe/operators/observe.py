"""What a query does: its plan as text, and counters that travel with it instead of a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def plan_text(df: DataFrame) -> str:
    """The formatted plan, as `explain("formatted")` prints it."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def bars(df: DataFrame) -> dict[str, bool]:
    """What a plan must not or must hold: pairwise joins, pushed filters, a bounded sort."""
    text = plan_text(df)
    return {
        "pairwise": "CartesianProduct" in text or "BroadcastNestedLoopJoin" in text,
        "pushed": "PushedFilters: [" in text and "PushedFilters: []" not in text,
        "bounded_sort": "TakeOrderedAndProject" in text,
        "python": "MapInArrow" in text or "ArrowEvalPython" in text or "FlatMapGroupsInPandas" in text,
    }


def counted(df: DataFrame, name: str, **counters) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that has `rows` and the given aggregates once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in counters.items()]), seen


def read_rows(df: DataFrame) -> tuple[list, int]:
    """The rows of a bounded read (a page, a lookup), and how many rows its scans gave to get them: what its work was, whatever came out."""
    rows = df.collect()

    def scanned(node) -> int:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return scanned(node.executedPlan())
        if "QueryStage" in name:
            return scanned(node.plan())
        children = node.children()
        if children.size():
            return sum(scanned(children.apply(i)) for i in range(children.size()))
        metrics = node.metrics()
        return metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0

    return rows, scanned(df._jdf.queryExecution().executedPlan())
