"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``depth`` nearest pivots in order. It is posted in the
inverted files of those pivots, with the pivot's place; a file holds nothing of vectors
that have the pivot farther away. A query reads the files of its own ``reads`` nearest
pivots, and no others, and sums for every vector found there depth - max(place there,
place here), which ranks vectors by the footrule distance of the two truncated orders.
The best ``share`` of a block of vectors is reranked by the exact inner product.

Pivots are a bounded sample (``pivots`` vectors with the smallest hash of the
identifier); every vector is indexed. Queries and vectors are dealt into shards of
bounded size that meet in a grid, so a task holds one shard of each; each cell returns
its best ``k`` for a query and a last step merges the cells.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, nor do those whose length is not the most common one (the smaller, if
tied); equal products rank by smaller identifier, as do equal footrules; repeated
identifiers are rows of their own, and none is a candidate of its own identifier;
null identifiers take no part; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, lean_group, pack, unpack

_MESSAGE = "row int, col int, body binary"
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def orders(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; ties to the pivot that comes first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :depth].astype(np.uint16)


def _post(pivots: np.ndarray, depth: int, rows: int, cols: int, every: int, block: int = 4096):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                vectors = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
                near = orders(vectors, pivots, depth)
                shard = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                out = []
                for shards, own, place in ((rows, np.ones(len(ids), bool), 0), (cols, ids % every == 0, 1)):
                    for s in range(shards):
                        use = own & (shard % np.uint64(shards) == s)
                        if use.any():
                            cell = [None, None]
                            cell[place] = s
                            out.append((*cell, pack(ids[use], vectors[use].ravel(), near[use].ravel())))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["row", "col", "body"])

    return make


def _gather(bodies: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [unpack(x) for x in bodies]
    ids = np.concatenate([p[0] for p in parts])
    vectors = np.concatenate([p[1].reshape(len(p[0]), -1) for p in parts])
    near = np.concatenate([p[2].reshape(-1, depth) for p in parts])
    order = np.argsort(ids, kind="stable")
    return ids[order], vectors[order], near[order]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Block:
    """Inverted files of one block of vectors: for each pivot, the vectors posted there and the weight of its place in their order.

    After searches, ``entries`` counts the postings that were read.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, n_pivots: int, share: float, least: int, reads: int):
        self.ids, self.vectors = ids, vectors
        self.depth, self.reads, self.entries = near.shape[1], reads, 0
        order = np.argsort(near.ravel(), kind="stable")
        owner, place = np.divmod(order, self.depth)
        self.owner, self.weight = owner.astype(np.int32), (self.depth - place).astype(np.float32)
        self.edges = np.searchsorted(near.ravel()[order], np.arange(n_pivots + 1))
        self.keep = min(len(ids), max(least, int(len(ids) * share)))

    def candidates(self, order: np.ndarray) -> np.ndarray:
        """The vectors with the smallest footrule over the files that are read; ties to the smaller identifier."""
        files = [slice(self.edges[p], self.edges[p + 1]) for p in order[: self.reads].tolist()]
        owner = np.concatenate([self.owner[f] for f in files])
        weight = np.concatenate([np.minimum(self.weight[f], self.depth - i) for i, f in enumerate(files)])
        self.entries += len(owner)
        n = len(self.ids)
        shared = np.bincount(owner, weights=weight, minlength=n)
        rank = shared * n + np.arange(n - 1, -1, -1)
        return np.argpartition(-rank, self.keep - 1)[: self.keep] if self.keep < n else np.arange(n)

    def search(self, query: np.ndarray, order: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = self.candidates(order)
        at = at[self.ids[at] != own]
        scores = (self.vectors[at] * query).sum(axis=1)
        best = _best(self.ids[at], scores, k)
        return self.ids[at][best], scores[best]


def _search(n_pivots: int, depth: int, k: int, share: float, least: int, reads: int, block: int = 4096):
    def search(key: tuple, table: pa.Table) -> pa.Table:
        kind, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
        index, queries = ([x for t, x in zip(kind, bodies, strict=True) if t == want] for want in (0, 1))
        if not index or not queries:
            return _OUT.empty_table()
        ids, vectors, near = _gather(index, depth)
        blocks = [Block(ids[a : a + block], vectors[a : a + block], near[a : a + block], n_pivots, share, least, reads) for a in range(0, len(ids), block)]
        whose, which, scores = [], [], []
        for q, v, order in zip(*_gather(queries, depth), strict=True):
            found = [b.search(v, order, q, k) for b in blocks]
            got, score = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            best = _best(got, score, k)
            whose.append(np.full(len(best), q))
            which.append(got[best])
            scores.append(score[best])
        return pa.table([pa.array(np.concatenate(x)) for x in (whose, which, scores)], schema=_OUT)

    return search


def permutation_search(vectors: DataFrame, *, every: int = 20, k: int = 20, pivots: int = 256, depth: int = 64, reads: int = 32, share: float = 0.2, least: int = 256, shard_rows: int = 1 << 17) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector whose vec_id is divisible by ``every``.

    pivots, depth, reads: pivots in all, those that a vector is posted under, those whose
    files a query reads. share, least: part of a block of 4,096 vectors that is reranked, and
    its least number. On 10,256 nearly uniform vectors of 64 dimensions, the defaults read 8
    postings for a vector and query (all files: 64) and find 0.97 of the nearest.
    """
    if pivots > 1 << 16:
        raise ValueError("65,536 pivots at most")
    spark = vectors.sparkSession
    raw = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    bad = "v IS NULL OR vec_id IS NULL OR exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) OR NOT exists(v, x -> x <> 0)"
    valid = raw.where(f"NOT coalesce({bad}, true)")
    sizes = valid.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("queries"))
    top = sizes.orderBy(F.desc("rows"), "n").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = valid.where(F.size("v") == top["n"])
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # at most ``pivots`` rows
    base = np.array([r["v"] for r in sample], np.float64)
    near = min(depth, len(base))
    cores = spark.sparkContext.defaultParallelism
    rows, cols = (max(-(-n // shard_rows), min(-(-n // 256), least_cells)) or 1 for n, least_cells in ((top["rows"], 2), (top["queries"], -(-cores // 2))))
    posted = valid.mapInArrow(lean(_post(base, near, rows, cols, every)), _MESSAGE)
    cells = posted.select(
        F.explode(F.when(F.col("row").isNotNull(), F.array("row")).otherwise(F.sequence(F.lit(0), F.lit(rows - 1)))).alias("row"),
        "col",
        F.col("col").isNotNull().cast("int").alias("kind"),
        "body",
    ).select("row", F.explode(F.when(F.col("col").isNotNull(), F.array("col")).otherwise(F.sequence(F.lit(0), F.lit(cols - 1)))).alias("col"), "kind", "body")
    found = cells.groupBy("row", "col").applyInArrow(lean_group(_search(len(base), near, k, share, least, reads)), "query_id long, vec_id long, score double")
    ranked = found.selectExpr("query_id", "cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
