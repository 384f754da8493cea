"""Helpers shared by the training-data operators.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``
as Parquet, so a lost executor costs a recomputation of its own tasks and
nothing else. Where the setting is absent a temporary folder is used in local mode,
as in tests; on a cluster that is an error.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="quarrylight-"))
    return _LOCAL[0]


class Scratch:
    """Tables written to the shared folder and read back, lineage cut."""

    made_so_far: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        Scratch.made_so_far.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of ``keep`` that nothing reads any more."""
        self._delete(df.scratch_path)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Deletes all tables that others have made after this one, once their results are written."""
        later = Scratch.made_so_far[Scratch.made_so_far.index(self) + 1 :]
        for other in later:
            other._delete(other.root)
            Scratch.made_so_far.remove(other)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def column_texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def remainder(doc_id: int | None, mod: int) -> int:
    """crc32 of the identifier's decimal text, modulo ``mod``; null is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def rows(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value: for each its type, its length and its bytes."""
    parts = [np.uint32(len(arrays)).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str.encode().ljust(8), np.uint64(a.size).tobytes(), a.tobytes()]
    return squeeze(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = unsqueeze(data)
    at, found = 4, []
    for _ in range(int.from_bytes(raw[:4], "little")):
        kind = np.dtype(raw[at : at + 8].decode().strip())
        size = int.from_bytes(raw[at + 8 : at + 16], "little")
        found.append(np.frombuffer(raw, kind, size, at + 16))
        at += 16 + size * kind.itemsize
    return found


def _trim() -> None:
    """Returns memory that was freed to the system; workers live on, and would hold it from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(make: Callable) -> Callable:
    """For ``mapInArrow``: gives memory back when a task begins and when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _trim()
        yield from make(batches)
        _trim()

    return run


def lean_group(make: Callable) -> Callable:
    """For ``applyInArrow``: gives memory back when a task begins and after so many bytes of groups."""
    held = [1 << 62]  # a task has a copy of its own

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if held[0] > 1 << 23:
            held[0] = 0
            _trim()
        held[0] += table.nbytes
        return make(key, table)

    return run


def hash_buckets(tasks: int, least: int = 16) -> int:
    """Buckets for what ``tasks`` tasks send by hash: two for each task, so that a bucket stays as large as a task's share at every size."""
    return max(least, 2 * tasks)


def gathered(df: DataFrame, rows: int, each: int) -> DataFrame:
    """In tasks of about ``each`` of ``rows`` rows, if it has more tasks; a small step then costs no more than its rows."""
    return df.coalesce(max(1, -(-rows // each)))


def splits(df: DataFrame) -> int:
    """How many tasks a scan of ``df`` has; plans, runs nothing."""
    return max(1, df.rdd.getNumPartitions())
