"""The staged search cascade and navigation, in batch: all phases are one plan.

phases: tables of query_id, path, score, in order of preference. Work is done for every
phase, and a query keeps the rows of its first phase that has any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, cap: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def cascade(phases: list[tuple[DataFrame, int]]) -> DataFrame:
    """query_id, phase, rank, path, score of each query's first phase with results. phases: (rows, most rows for a query)."""
    tagged = [ranked(rows.select("query_id", "path", "score"), cap).withColumn("phase", F.lit(i)) for i, (rows, cap) in enumerate(phases, 1)]
    every = reduce(DataFrame.unionByName, tagged)
    own = every.withColumn("first", F.min("phase").over(Window.partitionBy("query_id")))
    return own.where("phase = first").select("query_id", "phase", "rank", "path", "score")


SCOPES = ("aliases", "symbols", "content", "edges")


def navigate(sections: dict[str, DataFrame], each: int = 5, scope: str = "all") -> DataFrame:
    """query_id, section, rank, path, score: the first rows of every section, or of one."""
    if scope not in ("all", *SCOPES):
        raise ValueError(f"unknown scope {scope!r}")
    own = [ranked(rows.select("query_id", "path", "score"), each).withColumn("section", F.lit(name)) for name, rows in sections.items() if scope in ("all", name)]
    return reduce(DataFrame.unionByName, own).select("query_id", "section", "rank", "path", "score")
