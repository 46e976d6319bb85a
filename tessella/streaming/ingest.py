"""Incremental ingest: new files of a folder are taken once, whatever stops a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest_jsonl(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append ``work`` of each new file's rows to Parquet in ``out``; stops when all are taken.

    The query's checkpoint remembers which files are done, so a later call goes
    on where this one ended.
    """
    rows = spark.readStream.schema(schema).json(folder)
    rows = work(rows) if work else rows
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
