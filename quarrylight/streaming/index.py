"""The index loop: a stored code index that follows a tree of files.

A tick lists the tree (paths, times and sizes, no contents) and compares the list with the
one that the index was last brought in step with, which is stored with it. Files that are
new or differ are read once they have been quiet for a while, deleted ones leave at once,
and every so often all files are compared by their contents. List, index and time are one
version of the store, so a loop that stops between ticks, or within one, goes on where the
last version was: nothing is indexed twice and nothing is missed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import relevant
from ..store.buckets import Change, Store
from ..store.code_index import CodeIndex

TICK, QUIET, FULL = "2 seconds", 5.0, 30.0


class IndexLoop:
    """tree: the folder that is followed; root: the store. quiet, full: seconds without change before a file is read, and between full passes."""

    def __init__(self, spark: SparkSession, tree: str, root: str, *, quiet: float = QUIET, full: float = FULL, buckets: int = 64):
        self.spark, self.tree, self.root = spark, tree.rstrip("/"), root
        self.quiet, self.full, self.buckets = quiet, full, buckets

    def _files(self) -> DataFrame:
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.tree)
        top = self.tree.split(":", 1)[-1].lstrip("/")
        path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), "^" + "".join(c if c.isalnum() or c == "/" else "\\" + c for c in top) + "/", "")
        return raw.withColumn("path", path).where(relevant(F.col("path")))

    def listed(self) -> DataFrame:
        """path, modified (seconds), size; contents are not read."""
        return self._files().select("path", F.col("modificationTime").cast("double").alias("modified"), F.col("length").alias("size"))

    def contents(self) -> DataFrame:
        return self._files().select("path", F.col("content").cast("string").alias("content"))

    def tick(self, now: float) -> list[tuple[str, str]]:
        """Brings the index in step as of ``now``; path and status of what was indexed (at most those that changed)."""
        store = Store(self.spark, self.root)
        if not store.version:
            change = store.change()
            change.write("listing", self.listed().limit(0), "path", self.buckets)
            change.values["buckets"] = self.buckets
            return self._apply(CodeIndex.start(change, self.buckets), self.listed(), None, now, now)
        index, before = CodeIndex(store, store.values["buckets"]), store.read("listing")
        current, full_at = self.listed(), store.values.get("full_at", 0.0)
        if now - full_at >= self.full:
            return self._apply(index, current, None, now, now)
        a, b = before.alias("a"), current.alias("b")
        both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
        gone, fresh = F.col("b.path").isNull(), F.col("a.path").isNull() | (F.col("a.modified") != F.col("b.modified")) | (F.col("a.size") != F.col("b.size"))
        ready = both.where(gone | (fresh & (F.col("b.modified") <= now - self.quiet)))
        changed = ready.select(F.coalesce("b.path", "a.path").alias("path"), F.col("b.modified").alias("modified"), F.col("b.size").alias("size"))
        return [] if changed.isEmpty() else self._apply(index, changed, changed.select("path"), now, full_at)

    def _apply(self, index: CodeIndex, seen: DataFrame, paths: DataFrame | None, now: float, full_at: float) -> list[tuple[str, str]]:
        """seen: the listing of ``paths``, or of all; a path without a time is gone."""

        def also(change: Change) -> None:
            touched, rows = None, seen
            if paths is not None:
                touched = index.store.buckets_of("listing", paths)
                rows = index.store.read("listing", touched).join(paths, "path", "left_anti").unionByName(seen.where("modified IS NOT NULL"))
            change.write("listing", rows, "path", self.buckets, touched)
            change.values["full_at"] = full_at

        _, changes = index.refresh(self.contents(), paths, also=also)
        return sorted((r["path"], r["status"]) for r in changes.collect())

    def start(self, checkpoint: str, *, tick: str = TICK, clock: Callable[[], float] = time.time) -> StreamingQuery:
        """Ticks until stopped; a later start goes on from the store."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda batch, epoch: self.tick(clock()) and None).option("checkpointLocation", checkpoint).trigger(processingTime=tick).start()
