"""Usage analytics over tool-call events.

events: ts (timestamp), tool_name, operation, tokens_original, tokens_optimized,
error_message. All times of reference are arguments; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hour_label, saved_percent
from ..session import shared_folder
from .places import placed


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def tool_breakdown(events: DataFrame, limit: int = 50) -> DataFrame:
    """Calls and tokens by tool and operation, most calls first; a null operation is a group. Errors are counted too."""
    own = events.groupBy("tool_name", "operation").agg(
        F.count("*").alias("calls"),
        _sum("tokens_original").alias("tokens_original"),
        _sum("tokens_optimized").alias("tokens_optimized"),
        F.count("error_message").alias("errors"),
    )
    return own.orderBy(F.desc("calls"), "tool_name", F.asc_nulls_first("operation")).limit(limit)


def top_tools(events: DataFrame, key: str, limit: int = 50) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(limit)


def recent(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def daily_summary(events: DataFrame) -> DataFrame:
    """Calls and tokens of each day, derived from the events."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), _sum("tokens_original").alias("tokens_original"), _sum("tokens_optimized").alias("tokens_optimized"))


def hourly_spine(events: DataFrame, end: Column, hours: int = 24, key: str | None = None) -> DataFrame:
    """Sums of the ``hours`` hours up to and with that of ``end``; hours without events are 0."""
    keys = [key] if key else []
    first = F.date_trunc("hour", end) - F.expr(f"INTERVAL {hours - 1} HOURS")
    slots = F.explode(F.sequence(first, F.date_trunc("hour", end), F.expr("INTERVAL 1 HOUR"))).alias("hour")
    base = events.select(key).distinct() if key else events.sparkSession.range(1).select()
    spine = base.select(*keys, slots)
    window = (F.col("ts") >= first) & (F.col("ts") < F.date_trunc("hour", end) + F.expr("INTERVAL 1 HOUR"))
    sums = events.where(window).groupBy(*keys, F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("tokens_original").alias("o"), F.sum("tokens_optimized").alias("p"))
    joined = spine.join(sums, [*keys, "hour"], "left")
    return joined.select(*keys, "hour", hour_label(F.col("hour")).alias("label"), F.coalesce("o", F.lit(0)).cast("long").alias("tokens_original"), F.coalesce("p", F.lit(0)).cast("long").alias("tokens_optimized"))


def trailing_day(events: DataFrame, as_of: Column) -> DataFrame:
    """Calls, tokens and savings of the 24 hours before ``as_of``, in one pass."""
    own = events.where(F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS"))
    sums = own.agg(F.count("*").alias("calls"), _sum("tokens_original").alias("tokens_original"), _sum("tokens_optimized").alias("tokens_optimized"))
    return sums.withColumn("saved", F.col("tokens_original") - F.col("tokens_optimized")).withColumn("saved_percent", saved_percent(F.col("tokens_original"), F.col("tokens_optimized")))


def rollups(daily: DataFrame, as_of_day: Column) -> DataFrame:
    """Savings of the last 7 and 30 days, bounds inclusive, and of all days, in one pass."""

    def over(column: str, days: int | None) -> Column:
        value = F.col(column) if days is None else F.when(F.col("day") >= F.date_sub(as_of_day, days), F.col(column))
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    spans = (("week", 7), ("month", 30), ("life", None))
    return daily.agg(*(over(c, d).alias(f"{n}_{c}") for n, d in spans for c in ("calls", "tokens_original", "tokens_optimized")))


def session_counters(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("calls"), _sum("tokens_original").alias("tokens_original"), _sum("tokens_optimized").alias("tokens_optimized"))


def retain(events: DataFrame, as_of: Column, placeholder: str | None = None) -> DataFrame:
    """Events of the 24 hours before ``as_of``, without those of a placeholder tool. Write the rollup first."""
    own = events.where(F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS"))
    return own.where(F.col("tool_name") != placeholder) if placeholder else own


def stale_sessions(events: DataFrame, key: str, seconds: int = 300) -> DataFrame:
    """Gaps of more than ``seconds`` between events that follow each other in a session."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.lag(ts).over(Window.partitionBy(key).orderBy("ts", "event_id"))
    gaps = events.withColumn("gap_seconds", F.floor((ts - before) / 1000000).cast("long"))
    return gaps.where(F.col("gap_seconds") > seconds)


def sorted_rows(rows: DataFrame, column: str, tie: str, *, descending: bool = False) -> DataFrame:
    """A table as a viewer sorts it by a column, every row with its place: numbers by value, texts in any case, nulls last."""
    numeric = dict(rows.dtypes)[column].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))
    key = F.col(column) if numeric else F.lower(F.col(column).cast("string"))
    order = [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(tie)]
    return placed(rows, order, shared_folder(rows.sparkSession, "places"))
