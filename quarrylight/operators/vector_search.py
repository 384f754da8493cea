"""Exact vector search: one query, or a batch of queries in blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot


def scored(vectors: DataFrame, query: Column, *, measure: str = "cosine") -> DataFrame:
    value = (cosine if measure == "cosine" else dot)(F.col("vector"), query)
    return vectors.withColumn("score", value)


def top_k(vectors: DataFrame, query: Sequence[float], k: int, *, threshold: float | None = None, measure: str = "cosine") -> DataFrame:
    """The ``k`` best rows for one query: the query is a literal, so no join and no shuffle but the top's."""
    own = scored(vectors, F.array(*(F.lit(float(x)) for x in query)), measure=measure)
    if threshold is not None:
        own = own.where(F.col("score") >= threshold)
    return own.orderBy(F.desc("score"), "id").limit(k)


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, threshold: float = -1.0, most: int = 4096) -> DataFrame:
    """query_id, id, score, rank: the ``k`` best by cosine of every query, itself excepted.

    queries: query_id and vector, a set that a caller states. It goes to the tasks in
    slices by hash, of ``most`` rows or somewhat fewer; a task keeps the ``k`` best for a
    query over all that it reads and sends them once.
    """
    out, parts = "query_id long, id long, score double", None
    asked = queries.select("query_id", "vector")
    slices = max(1, -(-asked.count() * 5 // (4 * most)))
    for at in range(slices):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == at) if slices > 1 else asked
        rows = own.orderBy("query_id").toArrow()  # about ``most`` rows
        names = rows.column("query_id").to_numpy().astype(np.int64)
        q = np.array(rows.column("vector").to_pylist(), np.float64).reshape(len(names), -1)
        found = vectors.select("id", "vector").mapInArrow(_block_search(names, q, k, threshold), out)
        parts = found if parts is None else parts.unionByName(found)
    ranked = parts.withColumn("rank", F.expr("cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS int)"))
    return ranked.where(F.col("rank") <= k)


def _block_search(names: np.ndarray, q: np.ndarray, k: int, threshold: float):
    def search(batches):
        ids, scores = np.zeros((len(names), 0), np.int64), np.zeros((len(names), 0))  # the best so far, of each query
        for b in batches:
            if not b.num_rows or not len(names):
                continue
            x, mine = np.array(b.column("vector").to_pylist(), np.float64), b.column("id").to_numpy()
            scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
            s = np.divide(q @ x.T, scale, out=np.zeros_like(scale), where=scale > 0)
            s[(names[:, None] == mine[None, :]) | (s < threshold)] = -np.inf
            scores, ids = np.hstack([scores, s]), np.hstack([ids, np.broadcast_to(mine, s.shape)])
            best = np.lexsort((ids, -scores), axis=1)[:, :k]
            scores, ids = np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)
        kept = scores > -np.inf
        whose = np.broadcast_to(names[:, None], scores.shape)
        yield pa.RecordBatch.from_arrays([pa.array(whose[kept]), pa.array(ids[kept]), pa.array(scores[kept])], names=["query_id", "id", "score"])

    return search


def missing(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units without a vector, or whatever ``done`` lists."""
    return units.join(done.select(key).distinct(), key, "left_anti")
