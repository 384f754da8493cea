"""The dashboard's document: sums of four spans of time, breakdowns, recent rows and hours, of four kinds of events.

calls: ts, tool_name, operation, tokens_original, tokens_optimized, duration_ms, error_message.
loads: ts, skill_id. embeds and models: ts, query_text (queries of an embedding and of a
language model). Sums of days come from ``days``, the rollup, which outlives the events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hour_label, saved_percent

COUNTS = ["tool_calls", "skills_loaded", "embed_queries", "model_queries", "tokens_original", "tokens_optimized"]
#: Columns of ``sections``; texts that a section lacks are null, numbers 0.
COLUMNS = ["label", "operation", "seconds", "duration_ms", "error_message", *COUNTS, "saved", "saved_percent"]
SPANS = {"last_7d": 7, "last_30d": 30, "lifetime": None}
PLACEHOLDER, MOST, LOADS = "mcp_tool", 50, 10


def _counted(calls: DataFrame, loads: DataFrame, embeds: DataFrame, models: DataFrame, keys: list[Column]) -> DataFrame:
    """COUNTS of all kinds by keys of ``ts``, in one aggregation."""
    rows = [calls.select(*keys, F.lit(0).alias("kind"), "tokens_original", "tokens_optimized")]
    rows += [x.select(*keys, F.lit(k).alias("kind"), F.lit(0).cast("long").alias("tokens_original"), F.lit(0).cast("long").alias("tokens_optimized")) for k, x in enumerate((loads, embeds, models), 1)]
    names = [c for c in rows[0].columns if c not in ("kind", "tokens_original", "tokens_optimized")]
    each = [F.count(F.when(F.col("kind") == k, 1)).alias(c) for k, c in enumerate(COUNTS[:4])]
    return reduce(DataFrame.unionByName, rows).groupBy(*names).agg(*each, *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS[4:]))


def days(calls: DataFrame, loads: DataFrame, embeds: DataFrame, models: DataFrame) -> DataFrame:
    """day and COUNTS: the rollup."""
    return _counted(calls, loads, embeds, models, [F.to_date("ts").alias("day")])


def _seconds() -> Column:
    return F.unix_timestamp(F.col("ts").cast("timestamp")).alias("seconds")


def sections(calls: DataFrame, loads: DataFrame, embeds: DataFrame, models: DataFrame, rollup: DataFrame, as_of: Column) -> DataFrame:
    """section, place (from 1) and COLUMNS of past_24h, last_7d, last_30d, lifetime, tool_breakdown, top_skills, recent_skill_calls, recent_actions, hourly_savings, embed_recent.

    Calls of the placeholder tool are in no section. Lists hold at most 50 rows (recent skill
    calls 10): most calls or newest first, then by name and by all other values; hours are the
    24 up to that of ``as_of``, oldest first, with 0 where there is nothing.
    """
    calls = calls.where(F.col("tool_name") != PLACEHOLDER)
    recent = lambda x: x.where(F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS"))
    saved = F.col("tokens_original") - F.col("tokens_optimized")
    sums = lambda x: x.withColumn("saved", saved).withColumn("saved_percent", saved_percent(F.col("tokens_original"), F.col("tokens_optimized")))

    def section(name: str, rows: DataFrame, order: list | None = None, most: int = MOST) -> DataFrame:
        own = rows if order is None else rows.orderBy(*order).limit(most)  # at most ``most`` rows are numbered
        own = own.withColumn("place", F.row_number().over(Window.orderBy(*order)) if order else F.lit(1))
        held = [F.col(c).cast(KINDS[c]).alias(c) if c in own.columns else F.lit(None if KINDS[c] == "string" else 0).cast(KINDS[c]).alias(c) for c in COLUMNS]
        return own.select(F.lit(name).alias("section"), "place", *held)

    day = F.to_date(as_of)
    within = lambda n: F.lit(True) if n is None else F.col("day") >= F.date_sub(day, n)
    spans = {"past_24h": _counted(recent(calls), recent(loads), recent(embeds), recent(models), [])}
    spans |= {name: rollup.agg(*(F.coalesce(F.sum(F.when(within(n), F.col(c))), F.lit(0)).cast("long").alias(c) for c in COUNTS)) for name, n in SPANS.items()}
    out = [section(name, sums(rows)) for name, rows in spans.items()]
    n, newest = F.desc("tool_calls"), F.desc("seconds")
    tools = recent(calls).groupBy(F.col("tool_name").alias("label"), "operation").agg(F.count("*").alias("tool_calls"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS[4:]))
    out.append(section("tool_breakdown", tools, [n, "label", F.asc_nulls_first("operation")]))
    out.append(section("top_skills", recent(loads).groupBy(F.col("skill_id").alias("label")).agg(F.count("*").alias("skills_loaded")), [F.desc("skills_loaded"), "label"]))
    out.append(section("recent_skill_calls", loads.select(F.col("skill_id").alias("label"), _seconds()), [newest, "label"], LOADS))
    actions = recent(calls).select(F.col("tool_name").alias("label"), "operation", _seconds(), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("duration_ms", *COUNTS[4:])), "error_message")
    out.append(section("recent_actions", actions, [newest, "label", F.asc_nulls_first("operation"), "duration_ms", *COUNTS[4:], F.asc_nulls_first("error_message")]))
    hour = F.date_trunc("hour", as_of)
    spine = calls.sparkSession.range(1).select(F.explode(F.sequence(hour - F.expr("INTERVAL 23 HOURS"), hour, F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    by_hour = calls.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")).agg(*(F.sum(c).alias(c) for c in COUNTS[4:]))
    hours = spine.join(by_hour, "ts", "left").select(hour_label(F.col("ts")).alias("label"), _seconds(), *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[4:]))
    out.append(section("hourly_savings", sums(hours).drop("saved_percent"), ["seconds"]))
    out.append(section("embed_recent", recent(embeds).select(F.col("query_text").alias("label"), _seconds()), [newest, "label"]))
    return reduce(DataFrame.unionByName, out)


KINDS = {"label": "string", "operation": "string", "error_message": "string", "saved_percent": "double"} | dict.fromkeys(["seconds", "duration_ms", *COUNTS, "saved"], "long")


def document(rows: DataFrame) -> DataFrame:
    """One JSON text of ``sections``; values that are null are left out. At most some 240 rows meet."""
    body = F.struct("place", *COLUMNS)
    each = rows.groupBy("section").agg(F.sort_array(F.collect_list(body)).alias("rows"))
    return each.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", "rows"))))).alias("stats"))
