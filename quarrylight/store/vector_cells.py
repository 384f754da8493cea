"""Stored vectors in cells: an index for tables too large to scan for every query.

Cells are the neighbourhoods of centres, which a few rounds of k-means on a bounded sample
place; the rows of a cell lie in the bucket of the cell. A query reads its ``probes`` nearest
cells and scores all their vectors exactly, so only a neighbour in a cell that is not read
can be missed; with as many probes as cells the result is that of the exact scan. Cells are
many or few vectors; a batch meets them by an equal join on the cell, whose large sides Spark
splits, or without a shuffle where the queries' cells are small enough to be broadcast.

Exact search (``operators.vector_search``) stays what the library's other calls use.

Defined cases: vectors that are null, empty or hold null or non-finite components, and those
of another length than the centres, take no part; zero vectors have the score 0; a query is
no neighbour of its own identifier; equal scores rank by identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from .buckets import Change, Store


def _usable(rows: DataFrame) -> DataFrame:
    bad = "vector IS NULL OR size(vector) = 0 OR exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    return rows.where(f"NOT coalesce({bad}, true)")


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def centres(sample: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Centres of unit length; a centre that no vector is nearest to stays where it is."""
    x = _unit(np.asarray(sample, np.float64))
    own = np.unique(x, axis=0)
    own = own[np.linspace(0, len(own) - 1, min(cells, len(own))).astype(int)]
    for _ in range(rounds):
        near = (x @ own.T).argmax(axis=1)
        sums = np.zeros_like(own)
        np.add.at(sums, near, x)
        moved = _unit(sums)
        used = np.linalg.norm(moved, axis=1) > 0
        own[used] = moved[used]
    return own


def _nearest(own: np.ndarray, probes: int, column: str):
    """``column``: the nearest cell or cells of each vector, ties to the lower number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([len(v) == own.shape[1] for v in b.column("vector").to_pylist()], pa.bool_()))
            x = _unit(b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, own.shape[1]))
            order = np.argsort(-(x @ own.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            cells = pa.array(order[:, 0]) if column == "cell" else pa.array(order.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, cells], names=[*b.schema.names, column])

    return make


class VectorCells:
    """The vectors of a store below a folder (id, vector) and their cells."""

    def __init__(self, store: Store):
        self.store = store
        rows = store.read("centres").orderBy("cell").collect()  # ``cells`` rows
        self.centres = np.array([r["vector"] for r in rows], np.float64)

    @staticmethod
    def build(spark: SparkSession, root: str, vectors: DataFrame, *, cells: int = 256, sample: int = 16_384, rounds: int = 10) -> VectorCells:
        """sample: at most so many vectors, those with the smallest hash of their identifier, place the centres; all are stored."""
        store = Store(spark, root)
        if store.version:
            raise ValueError(f"{root} holds version {store.version}")
        own = _usable(vectors.select("id", F.col("vector").cast("array<double>").alias("vector")))
        top = own.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if top is None:
            raise ValueError("there are no vectors")
        drawn = own.where(F.size("vector") == top["n"]).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow()
        made = centres(drawn.column("vector").combine_chunks().flatten().to_numpy().reshape(drawn.num_rows, top["n"]), cells, rounds)
        change = store.change()
        change.write("centres", spark.createDataFrame([(i, v) for i, v in enumerate(made.tolist())], "cell int, vector array<double>"), "cell", 1)
        change.write("vectors", _placed(own, made), "cell", len(made))
        return VectorCells(change.commit())

    def with_rows(self, vectors: DataFrame, gone: DataFrame | None = None) -> VectorCells:
        """The next version, in which these vectors joined, or replaced those of their identifiers, and identifiers in ``gone`` went; centres stay.

        Where an old vector of an identifier lies is found in the identifiers of all cells; cells without changes are not written.
        """
        fresh = _placed(_usable(vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))), self.centres)
        leaving = vectors.select("id") if gone is None else vectors.select("id").unionByName(gone.select("id"))
        old = self.store.read("vectors").select("id", "cell").join(leaving, "id", "left_semi").select("cell")
        touched = self.store.buckets_of("vectors", old.unionByName(fresh.select("cell")))
        change: Change = self.store.change()
        change.write("vectors", self.store.read("vectors", touched).join(leaving, "id", "left_anti").unionByName(fresh), "cell", len(self.centres), touched)
        return VectorCells(change.commit())

    def asked(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, query (its vector), cell: the cells that each query reads."""
        own = _usable(queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")))
        kind = own.schema["query_id"].dataType.simpleString()
        near = own.mapInArrow(_nearest(self.centres, probes, "cells"), f"query_id {kind}, vector array<double>, cells array<int>")
        return near.select("query_id", F.col("vector").alias("query"), F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, k: int, *, probes: int = 16, threshold: float = -1.0) -> DataFrame:
        """query_id, id, score, rank: the ``k`` best by cosine of each query (query_id, vector) in its nearest cells, itself excepted."""
        asked = self.asked(queries, probes)
        met = self.store.read("vectors", self.store.buckets_of("vectors", asked.select("cell"))).join(asked, "cell").where("id <> query_id")
        scored = met.select("query_id", "id", cosine(F.col("query"), F.col("vector")).alias("score")).where(F.col("score") >= threshold)
        ranked = scored.withColumn("rank", F.expr("cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS int)"))
        return ranked.where(F.col("rank") <= k)


def _placed(rows: DataFrame, own: np.ndarray) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_nearest(own, 1, "cell"), f"id {kind}, vector array<double>, cell int")
