"""Spark result against DuckDB SQL: columns by name, rows as a multiset, values by type."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings links headings document_tags tombstones document_vectors embedder_models reading_labels".split()


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(_value(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), _value(v)) for k, v in x.items()))
    return x


def oracle(sql: str, sf: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def differences(df, sql: str, sf: str) -> str:
    """Empty if equal, else what differs."""
    names, rows = oracle(sql, sf)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(_value(r[names.index(c)]) for c in order) for r in rows)
    have = Counter(tuple(_value(r[c]) for c in order) for r in df.collect())
    if want == have:
        return "" if sum(want.values()) else "no rows"
    more, less = have - want, want - have
    return f"{sum(have.values())} rows against {sum(want.values())}; only in Spark {list(more)[:3]}; only in SQL {list(less)[:3]}"


if __name__ == "__main__":  # python tests/compare.py SF NAME...
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tests.conftest import session

    spark = session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        for q in [k for k in queries if k == name or k.startswith(name) and name.endswith("_")]:
            t = time.time()
            try:
                said = differences(queries[q](spark, sys.argv[1]), oracles[q], sys.argv[1]) if q in oracles else f"no SQL, {queries[q](spark, sys.argv[1]).count()} rows"
            except Exception as e:  # noqa: BLE001
                said = "FAILED " + str(e)[:600]
            print(f"{q}: {said or 'ok'} ({time.time() - t:.1f} s)", flush=True)
