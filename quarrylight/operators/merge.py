"""Incremental maintenance: differences, merges, retention. Every function returns a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path, status (added, changed, same, deleted) by content hash. Both: path, content_hash."""
    old, new = stored.select("path", F.col("content_hash").alias("old")), current.select("path", F.col("content_hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return old.join(new, "path", "full").select("path", status.alias("status"))


def index_report(differences: DataFrame) -> DataFrame:
    return differences.groupBy("status").agg(F.count("*").alias("n"))


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both, one for each key: the one with the largest ``order``, the new one if tied."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def upsert_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Columns of ``current`` where it has the path, else those of ``stored``."""
    rest = [c for c in stored.columns if c != "path"]
    a, b = stored.alias("a"), current.alias("b")
    picked = (F.when(F.col("b.path").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in rest)
    return a.join(b, F.col("a.path") == F.col("b.path"), "full").select(F.coalesce("b.path", "a.path").alias("path"), *picked)


def without_paths(rows: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """Rows that derive from none of ``paths``; the cascade of a deletion, table by table."""
    return rows.join(paths.select(F.col("path").alias(column)).distinct(), column, "left_anti")


def refresh_rows(old: DataFrame, fresh: DataFrame, changed: DataFrame, column: str = "file_path") -> DataFrame:
    """Derived rows (symbols, chunks, postings) after changed paths are built again."""
    return without_paths(old, changed, column).unionByName(fresh)


def keep_newest(rows: DataFrame, keys: list[str], order: str, n: int, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(tie)) if keys else Window.orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def session_gc(sessions: DataFrame, as_of, days: int = 30, n: int = 100) -> DataFrame:
    """Sessions of the last ``days`` days, then the ``n`` newest: a top-n, with no single sorting task."""
    age = as_of.cast("timestamp").cast("double") - F.col("modified_at").cast("timestamp").cast("double")
    return sessions.where(age <= days * 86400).orderBy(F.desc("modified_at"), F.desc("session_id")).limit(n)


def first_per_name(rows: DataFrame, name: str, score: str, tie: str, cap: int) -> DataFrame:
    """The best row of each name, then the ``cap`` best of those."""
    w = Window.partitionBy(name).orderBy(F.desc(score), tie)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").orderBy(F.desc(score), tie).limit(cap)


def line_delta(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, added, removed: lines of one text that the other lacks, repeats counted; ``key`` names a pair."""

    def lines(text: str, side: str) -> Column:
        return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.struct(F.lit(side).alias("side"), x.alias("line")))

    own = pairs.select(key, F.inline(F.concat(lines(before, "b"), lines(after, "a"))))
    times = own.groupBy(key, "line").agg(*(F.count(F.when(F.col("side") == s, 1)).alias(s) for s in "ab"))
    return times.groupBy(key).agg(F.sum(F.when(F.col("b") == 0, F.col("a")).otherwise(0)).alias("added"), F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(0)).alias("removed"))
