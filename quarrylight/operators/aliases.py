"""Learned aliases: a key-value table of search terms and what they resolved to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .containment import contained

FIRST, STEP, FLOOR = 0.8, 0.05, 0.1


def lookup(aliases: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Aliases whose term contains the query or is contained in it, in any case, best first."""
    term, q = F.lower("alias_term"), F.lit(query.lower())
    own = aliases.where(F.contains(term, q) | F.contains(q, term))
    return own.orderBy(F.desc("confidence"), F.desc("hit_count"), F.desc("last_used_at"), "alias_term", "resolved_path").limit(limit)


def lookup_batch(aliases: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, resolved_path, confidence: the same for a stated set of queries (query_id, text), the best alias of each path.

    Distinct terms and distinct texts meet where one contains the other; only those that do are joined with their aliases and queries.
    """
    known = aliases.groupBy(F.lower("alias_term").alias("term"), "resolved_path").agg(F.max("confidence").alias("confidence"))
    asked = queries.where(trimmed("text") != "").select("query_id", F.lower("text").alias("low"))
    terms, texts = known.select("term").where("term IS NOT NULL").distinct(), asked.select("low").distinct()

    def within(parts: DataFrame, part: str, wholes: DataFrame, whole: str) -> DataFrame:
        own = contained(parts.select(F.col(part).alias("part")), wholes.select(F.col(whole).alias("key"), F.col(whole).alias("whole")))
        return own.select(F.col("part").alias(part), F.col("key").alias(whole))

    close = within(terms, "term", texts, "low").unionByName(within(texts, "low", terms, "term")).distinct()
    return close.join(asked, "low").join(known, "term").groupBy("query_id", "resolved_path").agg(F.max("confidence").alias("confidence"))


def upsert(aliases: DataFrame, observed: DataFrame) -> DataFrame:
    """A new snapshot after a batch of observations of any number for a key.

    observed: alias_term, resolved_path, resolved_symbol, resolved_line, observed_at. m
    observations add m hits and m steps of confidence, at most 1; a new key starts at
    one hit. The last symbol and line that are not null replace the old ones.
    """
    key = ["alias_term", "resolved_path"]
    when = F.struct("observed_at", "resolved_symbol", "resolved_line")
    batch = observed.groupBy(*key).agg(
        F.count("*").alias("m"),
        F.max_by("resolved_symbol", F.when(F.col("resolved_symbol").isNotNull(), when)).alias("new_symbol"),
        F.max_by("resolved_line", F.when(F.col("resolved_line").isNotNull(), when)).alias("new_line"),
        F.min("observed_at").alias("first_at"),
        F.max("observed_at").alias("last_at"),
    )
    old, new = F.col("hit_count").isNotNull(), F.col("m").isNotNull()
    m = F.coalesce("m", F.lit(0))
    raised = F.when(old, F.col("confidence") + STEP * m).otherwise(FIRST + STEP * (m - 1))
    return aliases.join(batch, key, "full").select(
        *key,
        F.coalesce("new_symbol", "resolved_symbol").alias("resolved_symbol"),
        F.coalesce("new_line", "resolved_line").alias("resolved_line"),
        (F.coalesce("hit_count", F.lit(0)) + m).cast("long").alias("hit_count"),
        F.when(old & ~new, F.col("confidence")).otherwise(F.least(F.lit(1.0), raised)).alias("confidence"),
        F.coalesce("created_at", "first_at").alias("created_at"),
        F.coalesce("last_at", "last_used_at").alias("last_used_at"),
    )


def bump(aliases: DataFrame, used: DataFrame) -> DataFrame:
    """One more hit and a new time for the used keys; confidence stays. used: alias_term, resolved_path, used_at."""
    batch = used.groupBy("alias_term", "resolved_path").agg(F.count("*").alias("m"), F.max("used_at").alias("at"))
    joined = aliases.join(batch, ["alias_term", "resolved_path"], "left")
    return joined.withColumn("hit_count", F.col("hit_count") + F.coalesce("m", F.lit(0))).withColumn("last_used_at", F.coalesce("at", "last_used_at")).drop("m", "at")


def decay(aliases: DataFrame, as_of: Column) -> DataFrame:
    """Halves confidence after 30 days without use, down to the floor; drops rows after 90 days. Halves again on every run."""
    age = as_of.cast("timestamp").cast("double") - F.col("last_used_at").cast("timestamp").cast("double")
    halved = F.when((age > 30 * 86400) & (F.col("confidence") > FLOOR), F.greatest(F.lit(FLOOR), F.col("confidence") * 0.5)).otherwise(F.col("confidence"))
    return aliases.where(age <= 90 * 86400).withColumn("confidence", halved)


def learn(results: DataFrame, queries: DataFrame, at: Column) -> DataFrame:
    """Observations that make the best path of each answered query an alias of its whole text.

    results: query_id, path, rank, phase. queries: query_id, text. Hits by alias teach nothing.
    """
    best = results.where((F.col("rank") == 1) & (F.col("phase") != 1)).select("query_id", "path")
    joined = best.join(queries, "query_id")
    return joined.select(F.col("text").alias("alias_term"), F.col("path").alias("resolved_path"), F.lit(None).cast("string").alias("resolved_symbol"), F.lit(None).cast("int").alias("resolved_line"), at.alias("observed_at"))
