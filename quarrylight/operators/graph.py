"""One-hop queries and risk over an edge table (source, target) of files or symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import risk_level


def fan_in(edges: DataFrame) -> DataFrame:
    """target, n_dependents: distinct other sources of each target."""
    return edges.where("source <> target").select("target", "source").distinct().groupBy("target").agg(F.count("*").alias("n_dependents"))


def dependents(edges: DataFrame, limit: int = 10) -> DataFrame:
    """target, source, rank: the first ``limit`` other sources of each target, in order."""
    own = edges.where("source <> target").select("target", "source").distinct()
    ranked = own.withColumn("rank", F.expr("cast(row_number() OVER (PARTITION BY target ORDER BY source) AS int)"))
    return ranked.where(F.col("rank") <= limit)


def risk(edges: DataFrame) -> DataFrame:
    own = fan_in(edges)
    return own.withColumn("level", risk_level(F.col("n_dependents")))


def related(edges: DataFrame, symbols: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Edges either of whose ends has a name that contains ``needle`` in any case.

    edges: source_id, target_id, edge_type. symbols: id, name.
    """
    low = needle.lower()
    a = symbols.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    b = symbols.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    joined = edges.join(a, "source_id").join(b, "target_id")
    hit = F.contains(F.lower("source_name"), F.lit(low)) | F.contains(F.lower("target_name"), F.lit(low))
    return joined.where(hit).select("source_name", "target_name", "edge_type").orderBy("source_name", "target_name", "edge_type").limit(limit)


def incoming(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, dependent: files whose symbols have an edge into another file. symbols: id, file_path."""
    a = symbols.select(F.col("id").alias("source_id"), F.col("file_path").alias("dependent"))
    b = symbols.select(F.col("id").alias("target_id"), F.col("file_path").alias("file"))
    return edges.join(a, "source_id").join(b, "target_id").where("file <> dependent").select("file", "dependent").distinct()


def enclosed(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Extracted edges (file_path, line, target_name, edge_type) with the symbol they occur in: the last of the file that starts at or before the line.

    One pass over the starts and lines of a file in order; edges before the first symbol have none and go.
    """
    starts = symbols.select("file_path", F.col("start_line").alias("line"), F.lit(0).alias("kind"), F.col("id").alias("source_id"), F.lit(None).cast("string").alias("target_name"), F.lit(None).cast("string").alias("edge_type"))
    uses = raw.select("file_path", "line", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("source_id"), "target_name", "edge_type")
    before = Window.partitionBy("file_path").orderBy("line", "kind", "source_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(uses).withColumn("source_id", F.last("source_id", True).over(before))
    return placed.where("kind = 1 AND source_id IS NOT NULL").select("file_path", "source_id", "target_name", "edge_type").distinct()


def named_edges(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """source_id, target_id, edge_type: references go to every symbol of their name."""
    target = symbols.select(F.col("name").alias("target_name"), F.col("id").alias("target_id"))
    return references.join(target, "target_name").select("source_id", "target_id", "edge_type").distinct()


def resolve_edges(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges between symbols from extracted ones; this is an extension that makes extracted edges usable."""
    return named_edges(enclosed(raw, symbols), symbols)
