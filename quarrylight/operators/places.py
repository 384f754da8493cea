"""Places of rows in a whole table's order, without a single task that sorts or numbers it.

Rows are sorted into ranges, one a task; a row's place is its place in the range, moved by
the rows of the ranges before. The driver gets one count a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(rows: DataFrame, first: int, path: str, column: str = "unit") -> DataFrame:
    """``rows`` with dense numbers from ``first``, in the order of their partitions and of the rows in each.

    The rows are written to ``path`` and read from there, so that numbers stay what they are.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the place in the partition
    rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", at).write.parquet(path)
    own = rows.sparkSession.read.parquet(path)
    upto, offsets = first, []
    for r in own.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        offsets.append((r["_part"], upto))
        upto += r["n"]
    moved = rows.sparkSession.createDataFrame(offsets, "_part int, _first long")
    return own.join(F.broadcast(moved), "_part").withColumn(column, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def placed(rows: DataFrame, order: list, path: str, column: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in an order that has no ties."""
    return numbered(rows.orderBy(*order), 1, path, column)
