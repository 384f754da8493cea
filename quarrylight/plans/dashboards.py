"""The dashboard's sections over the driver's events, in which views load skills, clicks and purchases are queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard as D
from . import tables as R
from .registered import query

_SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in D.COUNTS)
_SAVED = "tokens_original - tokens_optimized AS saved, CASE WHEN tokens_original > 0 THEN round(100.0 * (tokens_original - tokens_optimized) / tokens_original, 1) ELSE 0 END AS saved_percent"
_AT = f"TIMESTAMP '{R.AS_OF}'"


def _list(name: str, rows: str, order: str, most: int = D.MOST) -> str:
    return f"SELECT '{name}' AS section, row_number() OVER (ORDER BY {order}) AS place, * FROM ({rows}) QUALIFY place <= {most}"


_NEWEST = "seconds DESC, label"
_PARTS = [
    *(f"SELECT '{s}' AS section, 1 AS place, *, {_SAVED} FROM (SELECT {_SUMS} FROM every WHERE {w})" for s, w in {"past_24h": f"ts >= {_AT} - INTERVAL 24 HOUR", "last_7d": f"ts::DATE >= {_AT}::DATE - 7", "last_30d": f"ts::DATE >= {_AT}::DATE - 30", "lifetime": "true"}.items()),
    _list("tool_breakdown", f"SELECT tool_name AS label, operation, count(*) AS tool_calls, sum(tokens_original)::BIGINT AS tokens_original, sum(tokens_optimized)::BIGINT AS tokens_optimized FROM calls WHERE ts >= {_AT} - INTERVAL 24 HOUR GROUP BY ALL", "tool_calls DESC, label, operation NULLS FIRST"),
    _list("top_skills", f"SELECT skill_id AS label, count(*) AS skills_loaded FROM loads WHERE ts >= {_AT} - INTERVAL 24 HOUR GROUP BY ALL", "skills_loaded DESC, label"),
    _list("recent_skill_calls", "SELECT skill_id AS label, epoch(ts)::BIGINT AS seconds FROM (SELECT skill_id, date_trunc('second', ts) AS ts FROM loads)", _NEWEST, D.LOADS),
    _list("recent_actions", f"SELECT tool_name AS label, operation, epoch(date_trunc('second', ts))::BIGINT AS seconds, event_id % 9 AS duration_ms, tokens_original, tokens_optimized, error_message FROM calls WHERE ts >= {_AT} - INTERVAL 24 HOUR", f"{_NEWEST}, operation NULLS FIRST, duration_ms, tokens_original, tokens_optimized, error_message NULLS FIRST"),
    _list("hourly_savings", f"""SELECT strftime(h, '%H:00') AS label, epoch(h)::BIGINT AS seconds, coalesce(sum(tokens_original), 0)::BIGINT AS tokens_original, coalesce(sum(tokens_optimized), 0)::BIGINT AS tokens_optimized,
        (coalesce(sum(tokens_original), 0) - coalesce(sum(tokens_optimized), 0))::BIGINT AS saved
        FROM (SELECT unnest(generate_series(date_trunc('hour', {_AT}) - INTERVAL 23 HOUR, date_trunc('hour', {_AT}), INTERVAL 1 HOUR)) AS h) LEFT JOIN calls ON date_trunc('hour', ts) = h GROUP BY h""", "seconds"),
    _list("embed_recent", f"SELECT query_text AS label, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM embeds WHERE ts >= {_AT} - INTERVAL 24 HOUR", _NEWEST),
]


@query(
    f"""WITH {R.EVENTS}, loads AS (SELECT CAST(ts AS TIMESTAMP) AS ts, 'user' || user_id AS skill_id FROM events WHERE event_type = 'view'),
    embeds AS (SELECT CAST(ts AS TIMESTAMP) AS ts, props AS query_text FROM events WHERE event_type = 'click'), models AS (SELECT CAST(ts AS TIMESTAMP) AS ts FROM events WHERE event_type = 'purchase'),
    every AS (SELECT ts, 1 AS tool_calls, 0 AS skills_loaded, 0 AS embed_queries, 0 AS model_queries, tokens_original, tokens_optimized FROM calls
        UNION ALL SELECT ts, 0, 1, 0, 0, 0, 0 FROM loads UNION ALL SELECT ts, 0, 0, 1, 0, 0, 0 FROM embeds UNION ALL SELECT ts, 0, 0, 0, 1, 0, 0 FROM models),
    sections AS ({" UNION ALL BY NAME ".join(f"({p})" for p in _PARTS)})
    SELECT section, place, {", ".join(c if D.KINDS[c] == "string" else f"coalesce({c}, 0) AS {c}" for c in D.COLUMNS)} FROM sections"""
)
def dashboard(spark, sf_dir):
    events = R.events(spark, sf_dir)
    text = R.table(spark, sf_dir, "events").select("event_id", F.col("props").alias("query_text"))
    calls = events.withColumn("duration_ms", F.col("event_id") % 9)
    loads = events.where("tool_name = 'view'").select("ts", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("skill_id"))
    asked = events.join(text, "event_id")
    embeds, models = (asked.where(F.col("tool_name") == kind).select("ts", "query_text") for kind in ("click", "purchase"))
    return D.sections(calls, loads, embeds, models, D.days(calls, loads, embeds, models), F.lit(R.AS_OF).cast("timestamp"))
