"""Shared storage for intermediate tables.

Lineage is cut by writing a table to the folder that the cluster names in
``spark.checkpoint.dir`` and reading it back, so that a lost executor costs
only the tasks it ran.  Where the setting is absent, a local master makes a
folder; a cluster is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessella.plans.materialize import checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a cluster must name one."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or checkpoint_dir(spark.sparkContext)


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody has used yet."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/tessella/{app}/{name}-{uuid.uuid4().hex}"


#: Paths written since each call of :func:`settled` that is under way.
_WRITTEN: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The table that ``make`` builds, materialised; the tables that it wrote on the way are deleted."""
    _WRITTEN.append([])
    try:
        df = make()
        path = new_path(df.sparkSession, name)
        df.write.parquet(path)
    finally:
        passing = _WRITTEN.pop()
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    for p in passing:
        delete(df.sparkSession, p)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, when its results are no longer read."""
    delete(spark, f"{shared_dir(spark).rstrip('/')}/tessella/{spark.sparkContext.applicationId}")


def slices(batch: pa.RecordBatch, column: int, most_rows: int = 2048, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, whole rows, of bounded text in ``column``; one row may exceed the bound."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        stop = min(max(at + 1, int(np.searchsorted(total, before + most_bytes, side="right"))), at + most_rows)
        yield batch.slice(at, stop - at)
        at = stop
