"""Sinks: snapshots and appends as Parquet, notes and sessions as text, events with their rollup.

A snapshot is written beside the one it replaces and named by its version, so a table
is never overwritten while it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import catalog_hash
from ..operators.learnings import render
from ..operators.usage import daily_summary, retain
from ..store.buckets import Store


def write_snapshot(rows: DataFrame, root: str, version: int, partition_by: list[str] | None = None) -> DataFrame:
    path = f"{root}/v{version:08d}"
    writer = rows.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return rows.sparkSession.read.parquet(path)


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version below ``root``; None if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(f"{root}/{names[-1]}") if names else None


def write_vectors(vectors: DataFrame, catalog: DataFrame, root: str, version: int) -> DataFrame:
    """A snapshot of vectors (id, vector) with a manifest of their number, their length and the catalog (name, content) they are of."""
    kept = write_snapshot(vectors, root, version)
    counted = kept.agg(F.count("*").alias("count"), F.max(F.size("vector")).alias("dim"))
    marked = catalog.agg(catalog_hash(F.col("name"), F.col("name"), F.col("content")).alias("fingerprint"))
    counted.join(marked).write.parquet(f"{root}/manifest-{version:08d}")  # one row each
    return kept


def current_vectors(spark: SparkSession, catalog: DataFrame, root: str, version: int) -> DataFrame | None:
    """The vectors of a version, if their manifest is of this catalog and of as many vectors; else None."""
    manifest = spark.read.parquet(f"{root}/manifest-{version:08d}").first()
    own = spark.read.parquet(f"{root}/v{version:08d}")
    mark = catalog.agg(catalog_hash(F.col("name"), F.col("name"), F.col("content")).alias("h")).first()["h"]
    return own if manifest["fingerprint"] == mark and manifest["count"] == own.count() else None


def log_calls(events: DataFrame, root: str, batch: str, as_of, placeholder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Appends a batch of events with its name; returns the rollup of all days and the events that are kept.

    A batch whose name is in the ledger changes nothing. Otherwise its events join those of
    their days, and its sums are added to the rollup of their days: no other day is read or
    written. Events beyond the time they are kept for leave a day when it is written and are
    not returned before.
    """
    spark = events.sparkSession
    store = Store(spark, root)
    named = spark.createDataFrame([(batch,)], "batch string")
    if "batches" not in store.tables or store.read("batches", store.buckets_of("batches", named)).where(F.col("batch") == batch).isEmpty():
        change = store.change()
        dated = events.withColumn("day", F.to_date("ts"))
        added = daily_summary(events)
        for name, rows, key in (("events", dated, "day"), ("daily", added, "day"), ("batches", named, "batch")):
            if name in store.tables:
                touched = store.buckets_of(name, rows.select(key))
                old = store.read(name, touched)
                if name == "daily":
                    rows = old.unionByName(rows).groupBy("day").agg(*(F.sum(c).alias(c) for c in rows.columns if c != "day"))
                else:
                    rows = (retain(old, as_of, placeholder) if name == "events" else old).unionByName(rows)
                change.write(name, rows, key, 64, touched)
            else:
                change.write(name, rows, key, 64)
        store = change.commit()
    return store.read("daily"), retain(store.read("events").drop("day"), as_of, placeholder)


def append_chunks(chunks: DataFrame, root: str) -> DataFrame:
    """Chunks (id, ...) after new ones joined, by identifier, or replaced theirs; only buckets of the new ones' identifiers are read and written."""
    store = Store(chunks.sparkSession, root)
    change, touched = store.change(), None
    if "chunks" in store.tables:
        touched = store.buckets_of("chunks", chunks.select("id"))
        chunks = store.read("chunks", touched).join(chunks.select("id"), "id", "left_anti").select(chunks.columns).unionByName(chunks)
    change.write("chunks", chunks, "id", 64, touched)
    return change.commit().read("chunks")


def append_events(events: DataFrame, root: str) -> None:
    """Usage events, partitioned by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(root)


def roll_and_retain(events: DataFrame, rollup_root: str, events_root: str, version: int, as_of, placeholder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes the daily rollup first, then the events that are kept; returns both."""
    daily = write_snapshot(daily_summary(events), rollup_root, version)
    return daily, write_snapshot(retain(events, as_of, placeholder), events_root, version)


def write_learnings(learnings: DataFrame, path: str) -> None:
    render(learnings).select(F.col("text").alias("value")).coalesce(1).write.text(path)  # one row


def write_sessions(sessions: DataFrame, path: str) -> None:
    """A folder for each session, with one JSON document; a session that is there is replaced, others stay."""
    own = sessions.withColumn("folder", F.col("session_id"))
    own.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").json(path)


def cached_vectors(units: DataFrame, cache: DataFrame, text: str, embed) -> DataFrame:
    """content_hash, vector: those of the cache, and new ones for texts whose hash it lacks."""
    hashed = units.select(F.md5(F.col(text).cast("binary")).alias("content_hash"), F.col(text).alias("_text")).dropDuplicates(["content_hash"])
    new = hashed.join(cache.select("content_hash"), "content_hash", "left_anti").select("content_hash", embed(F.col("_text")).alias("vector"))
    return cache.select("content_hash", "vector").unionByName(new)
