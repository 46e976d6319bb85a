"""Cutting lineage of iterative plans, in storage that executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are broadcast to leave rows out; more are joined.
BROADCAST_KEYS = 1_000_000


def checkpoint_dir(sc: SparkContext) -> str:
    """The session's checkpoint folder, or that of the setting.

    Where neither is named, a local master gets a folder of its own; a cluster
    is refused, as its executors don't share their disks.
    """
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tessella-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` through a reliable checkpoint in the folder of :func:`checkpoint_dir`."""
    checkpoint_dir(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` through compressed files in the folder of :func:`checkpoint_dir`; for rows that hold texts, a fraction of a checkpoint's size."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark.sparkContext).rstrip('/')}/tessella-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands at most so many rows at once to Python; the session's own setting holds again after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a :func:`written` table that is not read again, and lets Spark drop the shuffles that only finished plans refer to."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def joined_by_key(df: DataFrame, keys: DataFrame, key: str, how: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` joined with the counted, distinct rows of ``keys``: rows of ``df`` stay where they are unless the keys are too many to send."""
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, key, how)
