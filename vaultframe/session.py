"""Reading tables, cutting lineage and joining in the face of hot keys."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory. Columns and filters reach the scan by Catalyst."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where none is set a folder of this machine will do if all of Spark runs in
    this process, as in tests; on a cluster it would lose rows, so that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = "file://" + tempfile.mkdtemp(prefix="vaultframe-checkpoints-")
        named = _own["dir"]
    return named.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its scan has too few partitions to use them, as a single small file has; otherwise untouched. For scans
    that feed an Arrow pass, whose cost is in Python."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # its partitions are known only by running it
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet under the checkpoint folder and read again: lineage is cut, an executor's loss costs nothing,
    and later passes read only the columns they need. The files go at the end of the `scratch` they were written in, or else when the
    driver's process ends."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the checkpoint folder, which goes as what `materialize` writes does."""
    at = f"{checkpoint_dir(spark)}/vaultframe/{name}-{uuid.uuid4().hex}"
    atexit.register(release, spark, at)
    for written in _scratch[-1:]:
        written.append((spark, at))
    return at


_scratch: list[list] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what `materialize` wrote within it: for a driver that runs many queries, once a query's result is written."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, at in _scratch.pop():
            release(spark, at)


def release(spark: SparkSession, at: str) -> None:
    """Deletes what `materialize` wrote; silent once the session is gone."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where the bytes of a string or binary column, or the items of a list column, pass `most`, so that what a task holds of a
    batch doesn't follow the lengths of its values."""
    for batch in batches:
        values = batch.column(column)
        measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = pc.fill_null(measure(values), 0).to_numpy(zero_copy_only=False)
        start = 0
        ends = np.cumsum(sizes, dtype=np.int64)
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


#: A key is hot if it holds more than this share of the rows, or more than HOT_ROWS, which is about what one task takes well. The right rows of
#: the MOST_HOT keys of most rows are broadcast at most; a key beyond has less than a MOST_HOT-th of all rows, and is left to adaptive execution.
HOT_SHARE, HOT_ROWS, MOST_HOT = 0.005, 1_000_000, 10_000


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> list:
    """The keys of more than `share` of df's rows, or of more than `rows`: MOST_HOT at most. One job, partial counts before the shuffle."""
    seen = Observation()
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("rows")).observe(seen, F.sum("rows").alias("rows"))
    most = counts.filter("key is not null and rows > 1").orderBy(F.desc("rows"), "key").limit(MOST_HOT).collect()
    total = seen.get["rows"] or 0
    return [r["key"] for r in most if r["rows"] > max(1, min(total * share, rows))]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: float = HOT_SHARE, rows: int = HOT_ROWS) -> DataFrame:
    """left join right on `key`, where right has at most one row per key and left may hold a third of its rows on one key.
    The hot keys' right rows (MOST_HOT at most) are broadcast, so hot left rows never shuffle; all others meet by a shuffled join.
    how: left, inner, left_semi or left_anti. A null key matches nothing, as in SQL."""
    hot = hot_keys(left, key, share, rows)
    if not hot:
        return left.join(right, key, how)
    if len(hot) <= 1 / HOT_SHARE:
        is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
        few, rest, near, far = left.filter(is_hot), left.filter(~is_hot), right.filter(F.col(key).isin(hot)), right.filter(~F.coalesce(F.col(key).isin(hot), F.lit(False)))
    else:  # too many for a list in the plan
        kind = left.schema[key].dataType.simpleString()
        those = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], f"`{key}` {kind}"))
        few, rest, near, far = left.join(those, key, "left_semi"), left.join(those, key, "left_anti"), right.join(those, key, "left_semi"), right.join(those, key, "left_anti")
    return few.join(F.broadcast(near), key, how).unionByName(rest.join(far, key, how))
