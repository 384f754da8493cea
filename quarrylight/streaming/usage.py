"""Streaming twins of the usage rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import shared_folder


def read_events(spark: SparkSession, folder: str, schema, *, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """A stream of event files; ``ts`` becomes a timestamp, which watermarks need."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str, *, late: str = "24 hours", keys: tuple[str, ...] = ()) -> DataFrame:
    """Calls and value of tumbling windows; the watermark bounds the state that is kept."""
    own = events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys)
    return own.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("start"), *keys, "calls", "tokens")


def hourly(events: DataFrame, **options) -> DataFrame:
    return windowed(events, "1 hour", **options)


def daily(events: DataFrame, **options) -> DataFrame:
    return windowed(events, "1 day", **options)


def sessions(events: DataFrame, key: str, gap: str = "5 minutes", late: str = "24 hours") -> DataFrame:
    """Sessions of a key that end after a gap; an extension of the staleness rule."""
    own = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return own.agg(F.count("*").alias("calls")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "calls")


def drain(stream: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Runs a stream over all there is now and returns its table: the last state of every key.

    Update mode: a batch writes the keys it changed, and what the watermark has passed leaves
    the state. ``folder`` keeps batches and progress; a later call goes on from there.
    """
    spark = stream.sparkSession
    root = folder or shared_folder(spark, "stream")

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batches/epoch={epoch}")  # again after a failure, with the same rows

    query = stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    every = spark.read.schema(StructType([*stream.schema, StructField("epoch", LongType())])).parquet(f"{root}/batches")
    rest = [c for c in stream.columns if c not in keys]
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("last"))
    return last.select(*keys, *(f"last.{c}" for c in rest))
