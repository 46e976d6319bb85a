"""Exact ranks within groups of any size.

Rows are ranked in the order of a hexadecimal digest.  The digest's first three
digits cut each group into 4,096 even ranges: rows are ranked within a range,
and the sizes of the ranges before are added.  So a group that holds a third of
all rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: Column, digest: Column, ties: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the rank (from 1) of each row in its group; a null group is a group."""
    rows = df.withColumn("__g", F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))).withColumn("__d", F.coalesce(digest, F.lit("")))
    rows = rows.withColumn("__r", F.substring("__d", 1, 3))
    sizes = rows.groupBy("__g", "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy("__g").orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__g", "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(W.partitionBy("__g", "__r").orderBy("__d", *ties))
    return rows.withColumn("__i", inner).join(offsets, ["__g", "__r"]).withColumn(name, F.col("__before") + F.col("__i")).drop("__g", "__d", "__r", "__i", "__before")
