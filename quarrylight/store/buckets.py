"""Tables in buckets below one folder, with versions.

A table's rows lie in buckets by the hash of a key, each bucket in a folder of its own. A
version is one small file that names the folder in which every bucket of every table lies;
it also holds values of the tables' owner. A change writes new folders for the buckets it
touches, then the file of the next version: readers see all of it or nothing, buckets that
nothing touched are neither read nor written, and a version that was opened stays readable
until ``vacuum`` deletes what no kept version names.

Two changes of one version conflict: the version that a change would make is claimed by
creating a file that must not be there, and the second claim fails. A change that died
between its claim and its version is undone by ``abandon``.

The driver holds names of buckets, as many as tables times buckets, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .folder import Folder


class Conflict(RuntimeError):
    """Another change has made the next version."""


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass
class Table:
    """Where a table's buckets lie. key: what is hashed; at: the folder of each bucket that has rows."""

    key: str
    buckets: int
    schema: str
    at: dict[int, str] = field(default_factory=dict)


class Store:
    """A version of the tables below ``root``; ``Store(spark, root)`` opens the newest, or an empty one."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.folder = spark, Folder(spark, root)
        self.version = max(self.versions(), default=0) if version is None else version
        self.tables: dict[str, Table] = {}
        self.values: dict = {}
        if self.version:
            stored = json.loads(self.folder.read(f"_versions/{self.version:08d}.json"))
            self.values = stored["values"]
            self.tables = {n: Table(t["key"], t["buckets"], t["schema"], {int(b): f for f, own in t["at"].items() for b in own}) for n, t in stored["tables"].items()}

    def versions(self) -> list[int]:
        return [int(n[:8]) for n in self.folder.names("_versions") if len(n) == 13 and n.endswith(".json")]

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a table, or of some of its buckets; no other folder is listed or read."""
        own = self.tables[name]
        schema = StructType.fromJson(json.loads(own.schema))
        which = own.at if buckets is None else [b for b in buckets if b in own.at]
        paths = [f"{self.folder.root}/{name}/v={own.at[b]}/bucket={b}" for b in which]
        if not paths:
            return self.spark.createDataFrame([], schema)
        every = StructType([*schema.fields, StructField("v", StringType()), StructField("bucket", IntegerType())])
        return self.spark.read.schema(every).option("basePath", f"{self.folder.root}/{name}").parquet(*paths).select(*(F.col(f"`{f.name}`") for f in schema.fields))

    def buckets_of(self, name: str, keys: DataFrame) -> list[int]:
        """The buckets that hold the keys, which are the only column of ``keys``."""
        return sorted(r[0] for r in keys.select(bucket_of(keys.columns[0], self.tables[name].buckets)).distinct().collect())

    def change(self) -> Change:
        return Change(self)

    def abandon(self) -> None:
        """Frees versions that were claimed and never made, once no change is under way."""
        made = set(self.versions())
        for n in self.folder.names("_claims"):
            if n.isdigit() and int(n) not in made and int(n) > self.version:
                self.folder.delete(f"_claims/{n}")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the ``keep`` newest versions names, and older versions; returns how many folders went."""
        versions = sorted(self.versions())
        kept = [Store(self.spark, self.folder.root, v) for v in versions[-keep:]]
        named = {(n, f) for s in kept for n, t in s.tables.items() for f in t.at.values()}
        gone = 0
        for name in self.folder.names(""):
            for v in self.folder.names(name) if not name.startswith("_") else []:
                if v.startswith("v=") and (name, v[2:]) not in named:
                    self.folder.delete(f"{name}/{v}")
                    gone += 1
        for v in versions[:-keep]:
            self.folder.delete(f"_versions/{v:08d}.json")
        return gone


class Change:
    """New folders for some buckets of some tables, which ``commit`` makes the next version."""

    def __init__(self, before: Store):
        self.before, self.number = before, before.version + 1
        self.mark = f"{self.number:08d}-{uuid.uuid4().hex[:8]}"
        self.tables = {n: Table(t.key, t.buckets, t.schema, dict(t.at)) for n, t in before.tables.items()}
        self.values = json.loads(json.dumps(before.values))
        self.written: dict[str, list[int]] = {}

    def write(self, name: str, rows: DataFrame, key: str, buckets: int, touched: Iterable[int] | None = None) -> None:
        """``rows`` become all rows of the ``touched`` buckets (of the table, if None); spread over tasks by bucket, large buckets over several."""
        old = self.tables.get(name)
        own = Table(key, old.buckets if old else buckets, rows.schema.json(), {} if touched is None or old is None else old.at)
        for b in touched or []:
            own.at.pop(b, None)
        folder = f"{self.before.folder.root}/{name}/v={self.mark}"
        placed = rows.withColumn("bucket", bucket_of(key, own.buckets))
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(folder)
        made = [int(n[7:]) for n in self.before.folder.names(f"{name}/v={self.mark}") if n.startswith("bucket=")]
        own.at |= dict.fromkeys(made, self.mark)
        self.tables[name], self.written[name] = own, made

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a table as this change leaves it."""
        after = Store(self.before.spark, self.before.folder.root, self.before.version)
        after.tables = self.tables
        return after.read(name, buckets)

    def commit(self) -> Store:
        folder = self.before.folder
        if not folder.claim(f"_claims/{self.number:08d}"):
            raise Conflict(f"version {self.number} is there already")
        tables = {}
        for n, t in self.tables.items():
            at: dict[str, list[int]] = {}
            for b, f in sorted(t.at.items()):
                at.setdefault(f, []).append(b)
            tables[n] = {"key": t.key, "buckets": t.buckets, "schema": t.schema, "at": at}
        folder.write(f"_versions/{self.number:08d}.json", json.dumps({"values": self.values, "tables": tables}))
        return Store(self.before.spark, folder.root, self.number)
