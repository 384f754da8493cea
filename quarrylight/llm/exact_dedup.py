"""Exact deduplication by a tree-merge of sorted digest runs.

Every partition sorts its digests into one run. Runs are exchanged in binomial rounds, as
on a hypercube whose axes have ``fan`` places: the number of a run and the digest are both
written in base ``fan``, and in round r a run is cut by the digest's r-th digit and its
parts go to the runs whose numbers have that digit in the r-th place and agree elsewhere. A
task merges the ``fan`` sorted runs that it gets, two by two in a tournament, and keeps for
every digest the identifier that stays and the number of rows. After as many rounds as the
number of partitions has digits, all runs of a digest have met. A round sends ``fan``
messages for each run, whatever the size of the table, and a digest takes one entry of a
run however many rows share it, so a group of copies that holds a third of all rows costs
no more than any other.

Equality is verified: the key is SHA-256 together with the byte length and an independent
64-bit hash, so texts that differ in any of them never merge.

Defined cases: null text is empty; null identifiers lose to all others; of rows with the
same text and identifier exactly one is kept; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, lean, lean_group, pack, partition_id, splits, unpack

_RUN = pa.schema([("run", pa.int64()), ("body", pa.binary())])
_RUN_DDL = "run long, body binary"
_MERGED = "sha binary, n_bytes long, other long, keep_id long, keep_row long, group_size long"
_KEY = np.dtype("S48")


@dataclass
class Run:
    """Keys in rising order, each once; of each the identifier that stays, its row and the number of rows."""

    key: np.ndarray
    keep: np.ndarray
    row: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(key: np.ndarray, ids: np.ndarray, rows: np.ndarray, largest: bool) -> Run:
        order = np.argsort(key, kind="stable")
        return Run(key[order], ids[order], rows[order], np.ones(len(key), np.int64))._distinct(largest)

    def _distinct(self, largest: bool) -> Run:
        """Equal keys, which are neighbours, become one."""
        if not len(self.key):
            return self
        start = np.flatnonzero(np.r_[True, self.key[1:] != self.key[:-1]])
        if len(start) == len(self.key):
            return self
        group = np.cumsum(np.r_[False, self.key[1:] != self.key[:-1]])
        order = np.lexsort((self.row, self.keep, group))  # within a key, by identifier and row
        stays = order[np.r_[start[1:], len(order)] - 1 if largest else start]
        return Run(self.key[start], self.keep[stays], self.row[stays], np.add.reduceat(self.count, start))

    def merged(self, other: Run, largest: bool) -> Run:
        """Both runs in one, without sorting again: each key goes to its own place and that among the other's."""
        mine = np.arange(len(self.key)) + np.searchsorted(other.key, self.key, side="left")
        theirs = np.arange(len(other.key)) + np.searchsorted(self.key, other.key, side="right")
        out = []
        for a, b in zip((self.key, self.keep, self.row, self.count), (other.key, other.keep, other.row, other.count), strict=True):
            both = np.empty(len(mine) + len(theirs), a.dtype)
            both[mine], both[theirs] = a, b
            out.append(both)
        return Run(*out)._distinct(largest)

    @staticmethod
    def merge(runs: list[Run], largest: bool) -> Run:
        """A tournament over any number of runs."""
        while len(runs) > 1:
            runs = [a.merged(b, largest) for a, b in zip(runs[::2], runs[1::2], strict=False)] + runs[len(runs) & ~1 :]
        return runs[0]

    def store(self) -> bytes:
        return pack(np.frombuffer(self.key.tobytes(), np.uint8), self.keep, self.row, self.count)

    @staticmethod
    def load(body: bytes) -> Run:
        key, *rest = unpack(body)
        return Run(key.view(_KEY), *rest)

    def dealt(self, number: int, place: int, fan: int) -> pa.RecordBatch:
        """Messages of the round for one place of numbers."""
        lead = self.key.view(np.uint8).reshape(-1, _KEY.itemsize)[:, :8].copy().view("<u8").ravel()
        weight = fan**place
        digit = ((lead // np.uint64(weight)) % np.uint64(fan)).astype(np.int64)
        base, to, bodies = number - number // weight % fan * weight, [], []
        for d in range(fan):
            own = digit == d
            if own.any():
                to.append(base + d * weight)
                bodies.append(Run(self.key[own], self.keep[own], self.row[own], self.count[own]).store())
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(bodies, pa.binary())], schema=_RUN)


def _runs(fan: int, largest: bool, lowest: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = []
        for b in batches:
            if b.num_rows:
                sha = np.frombuffer(b"".join(b.column("sha").to_pylist()), np.uint8).reshape(-1, 32)
                rest = [b.column(c).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8) for c in ("n_bytes", "other")]
                key = np.ascontiguousarray(np.hstack([sha, *rest])).view(_KEY).ravel()
                ids = b.column("doc_id").fill_null(lowest).to_numpy(zero_copy_only=False)
                runs.append(Run.of(key, ids, b.column("row").to_numpy(zero_copy_only=False), largest))
        if runs:
            yield Run.merge(runs, largest).dealt(partition_id(), 0, fan)

    return make


def _round(place: int, fan: int, largest: bool, last: bool):
    """Merges the runs that meet; deals them for the next place, if there is one."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        run = Run.merge([Run.load(x) for x in table.column("body").to_pylist()], largest)
        if last:
            return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([run.store()], pa.binary())], schema=_RUN)
        return pa.Table.from_batches([run.dealt(key[0].as_py(), place + 1, fan)])

    return merge


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of more than one row."""
    names = [x.split()[0] for x in _MERGED.split(", ")]
    for b in batches:
        for run in map(Run.load, b.column("body").to_pylist()):
            own = np.flatnonzero(run.count > 1)
            raw = run.key[own].tobytes()
            width = _KEY.itemsize
            sha = pa.array([raw[i : i + 32] for i in range(0, len(raw), width)], pa.binary())
            n_bytes, other = np.frombuffer(raw, np.uint8).reshape(-1, width)[:, 32:].copy().view(">i8").astype(np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([sha, *map(pa.array, (n_bytes, other, run.keep[own], run.row[own], run.count[own]))], names=names)


def exact_dedup(docs: DataFrame, *, keep: str = "largest", fan: int = 8) -> DataFrame:
    """One row for every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "largest" or "smallest", the identifier that stays. fan: runs that a task merges
    in a round; with 2, partitions exchange runs in pairs.
    """
    largest = keep == "largest"
    lowest = -(2**63) if largest else 2**63 - 1
    scratch = Scratch(docs.sparkSession, "exact")
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    hashed = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.unhex(F.sha2(raw, 256)).alias("sha"),
        F.octet_length(raw).cast("long").alias("n_bytes"),
        F.xxhash64(raw).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )
    table = scratch.keep(hashed, "digests")
    places, number = 1, splits(table)
    while fan**places < number:
        places += 1
    runs = table.mapInArrow(lean(_runs(fan, largest, lowest)), _RUN_DDL)
    for place in range(places):
        runs = runs.groupBy("run").applyInArrow(lean_group(_round(place, fan, largest, place + 1 == places)), _RUN_DDL)
    groups = runs.mapInArrow(lean(_open), _MERGED)
    joined = table.join(groups, ["sha", "n_bytes", "other"], "left")
    stays = F.when(F.col("group_size").isNull(), F.col("doc_id")).when(F.col("keep_id") != lowest, F.col("keep_id"))
    return joined.select(
        "doc_id",
        stays.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = {
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
}
