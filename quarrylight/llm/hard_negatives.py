"""Hard negatives by bit-sliced integer products.

Components are whole numbers of ``planes`` bits in two's complement: the topmost bit
counts as -2^(planes - 1), bit j as 2^j. A vector is kept as its bit-planes, each a string
of one bit a component, so that the product of two vectors is the sum over pairs of planes
of their weights times the number of bits set in both.

For an anchor, the planes of all candidates are taken most significant first. After the
planes from j on, what is missing of a score is the anchor's product with numbers from 0 to
2^j - 1, so the score lies between what is summed so far plus 2^j - 1 times the sum of the
anchor's negative components, and the same with its positive ones. The interval halves with
every plane, and a candidate is dropped once it cannot qualify:

* for positives: once as many others have intervals that begin beyond its end as are wanted;
* for negatives: once for every positive its interval lies outside the range allowed, or as
  many others that are surely inside the range begin beyond its end.

Scores of those that stay are exact after the last plane. Ends that touch never drop a
candidate, so ties are decided by identifiers at last.

Anchors and candidates are dealt by their row numbers into shards of bounded size that meet
in a grid, so labels and copies of a vector do not decide where a row goes; a cell returns
at most what is wanted for each anchor and positive, and rounds of ``fan`` shards merge them.

Defined cases: rows whose vec_id, label or vector is null, or that hold null or non-finite
components, take no part, nor do those whose length is not the most common one (the smaller,
if tied); rows that share a vec_id are rows of their own, each an anchor if the vec_id is
one, and candidates of each other; copies are ranked by their place in the table as it was
read; components so large that products could exceed 62 bits are an error; without rows the
result is empty; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, lean_group, pack, unpack
from .integer_vectors import Vectors, integers, packed

_CELL = "cell_row int, cell_col int, body binary"
_POSITIVE = "anchor long, anchor_id long, shard int, row long, positive_id long, positive_score long"
_NEGATIVE = "anchor long, anchor_id long, place int, positive_id long, positive_score long, shard int, row long, negative_id long, negative_score long"
_ARROW = {"long": pa.int64(), "int": pa.int32()}


def slices(v: np.ndarray, planes: int) -> np.ndarray:
    """Bit-planes of each row, lowest first: rows x planes x words of 64 components."""
    words = -(-v.shape[1] // 64)
    bits = ((v[:, None, :] >> np.arange(planes)[None, :, None]) & 1).astype(np.uint8)
    out = np.zeros((len(v), planes, words * 8), np.uint8)
    packed_bits = np.packbits(bits, axis=2, bitorder="little")
    out[:, :, : packed_bits.shape[2]] = packed_bits
    return out.view(np.uint64)


def weights(planes: int) -> np.ndarray:
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


class Anchor:
    """A vector as its planes, with the sums of its negative and positive components."""

    def __init__(self, sliced: np.ndarray):
        self.sliced, self.weights = sliced, weights(len(sliced))
        bits = np.unpackbits(sliced.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
        v = (bits * self.weights[:, None]).sum(axis=0)
        self.down, self.up = int(v[v < 0].sum()), int(v[v > 0].sum())

    def share(self, plane: np.ndarray, j: int) -> np.ndarray:
        """What plane ``j`` of candidates adds to their scores."""
        both = np.bitwise_count(plane[:, None, :] & self.sliced[None]).sum(axis=2, dtype=np.int64)
        return (both @ self.weights) * self.weights[j]

    def narrowed(self, sliced: np.ndarray, at: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, int]:
        """Those of the candidates ``at`` that ``keep(low, high)`` leaves to the end, their scores, and how many planes were multiplied."""
        score, work = np.zeros(len(at), np.int64), 0
        for j in range(len(self.weights) - 1, -1, -1):
            score = score + self.share(sliced[at, j], j)
            work += len(at)
            rest = (1 << j) - 1
            stay = keep(score + rest * self.down, score + rest * self.up)
            if not stay.all():
                at, score = at[stay], score[stay]
        return at, score, work


def _largest(values: np.ndarray, k: int) -> int | None:
    """The k-th largest, if there are so many."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def nearest_ones(k: int):
    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        least = _largest(low, k)
        return np.ones(len(low), bool) if least is None else high >= least

    return keep


def ones_within(ranges: list[tuple[int, int]], k: int):
    """Keeps what can be among the first ``k`` of any range."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for begin, end in ranges:
            least = _largest(low[(low >= begin) & (high <= end)], k)
            stay |= (low <= end) & (high >= (begin if least is None else max(begin, least)))
        return stay

    return keep


def _first(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -score))[:k]


def _deal(planes: int, shards: int, column: int):
    """Blocks of rows by shard, sliced; they go to cells that have that shard as their row (0) or column (1)."""

    def make(row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, v: np.ndarray) -> list[tuple]:
        shard = (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)
        out = []
        for s in np.unique(shard).tolist():
            use = shard == s
            cell = (None, s) if column else (s, None)
            out.append((*cell, pack(row[use], vec_id[use], label[use], slices(v[use], planes).ravel())))
        return out

    return make


def _merged(bodies: list[bytes], planes: int, words: int) -> tuple[np.ndarray, ...]:
    parts = [unpack(x) for x in bodies]
    row, vec_id, label = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return row, vec_id, label, np.concatenate([p[3].reshape(-1, planes, words) for p in parts])


def _cell(planes: int, words: int, schema: str, search):
    """``search(cell_row, anchors, candidates, extra)`` for what meets in a cell; extra: the anchors' other messages."""
    fields = [f.split(" ") for f in schema.split(", ")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
        anchors, candidates, extra = ([x for t, x in zip(kind, bodies, strict=True) if t == k] for k in (1, 0, 2))
        found = search(key[0].as_py(), _merged(anchors, planes, words), _merged(candidates, planes, words), extra) if anchors and candidates else []
        columns = [np.concatenate([f[i] for f in found]) if found else [] for i in range(len(fields))]
        return pa.table([pa.array(c, _ARROW[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return run


def _positives(k: int):
    def search(shard: int, anchors: tuple, candidates: tuple, extra: list) -> list:
        row, vec_id, label, sliced = candidates
        order = np.argsort(label, kind="stable")
        ranked, found = label[order], []
        for a_row, a_id, a_label, a_sliced in zip(*anchors, strict=True):
            at = order[np.searchsorted(ranked, a_label) : np.searchsorted(ranked, a_label, "right")]
            at, score, _ = Anchor(a_sliced).narrowed(sliced, at[row[at] != a_row], nearest_ones(k))
            best = _first(score, vec_id[at], row[at], k)
            n = len(best)
            found.append((np.full(n, a_row), np.full(n, a_id), np.full(n, shard), row[at[best]], vec_id[at[best]], score[best]))
        return found

    return search


def _negatives(k: int, low: int, high: int):
    def search(shard: int, anchors: tuple, candidates: tuple, extra: list) -> list:
        row, vec_id, label, sliced = candidates
        known: dict[int, list[tuple[int, int, int]]] = {}
        for x in extra:
            for a, place, positive, score in zip(*(c.tolist() for c in unpack(x)), strict=True):
                known.setdefault(a, []).append((place, positive, score))
        found = []
        for a_row, a_id, a_label, a_sliced in zip(*anchors, strict=True):
            wanted = [(place, positive, s, -(-low * s // 100), high * s // 100) for place, positive, s in known.get(int(a_row), [])]
            wanted = [w for w in wanted if w[3] <= w[4]]
            if not wanted:
                continue
            at, score, _ = Anchor(a_sliced).narrowed(sliced, np.flatnonzero(label != a_label), ones_within([w[3:] for w in wanted], k))
            for place, positive, s, begin, end in wanted:
                inside = np.flatnonzero((score >= begin) & (score <= end))
                best = inside[_first(score[inside], vec_id[at[inside]], row[at[inside]], k)]
                n = len(best)
                found.append((np.full(n, a_row), np.full(n, a_id), np.full(n, place), np.full(n, positive), np.full(n, s), np.full(n, shard), row[at[best]], vec_id[at[best]], score[best]))
        return found

    return search


def _best(found: DataFrame, keys: list[str], order: list, k: int, shards: int, fan: int = 64) -> DataFrame:
    """The first ``k`` of each key, with ``rank``; ``fan`` shards meet in a window, then their winners."""
    while True:
        groups = -(-shards // fan)
        at = F.floor(F.col("shard") / fan).cast("int") if groups > 1 else F.lit(0)
        found = found.withColumn("shard", at)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "shard").orderBy(*order))).where(F.col("rank") <= k)
        if groups <= 1:
            return ranked
        found, shards = ranked.drop("rank"), groups


class Miner:
    """Cells in which all anchors meet all candidates."""

    def __init__(self, vectors: Vectors, every: int, shard_rows: int, shard_anchors: int):
        rows = vectors.rows
        anchors = rows.where(F.col("vec_id") % every == 0)
        cores = rows.sparkSession.sparkContext.defaultParallelism
        self.planes, self.words = vectors.most.bit_length() + 1, -(-vectors.width // 64)
        self.rows = max(-(-vectors.count // shard_rows), min(-(-vectors.count // 1024), cores))
        self.cols = max(1, -(-anchors.count() // shard_anchors))
        deal = lambda df, shards, column: packed(df, vectors.width, _deal(self.planes, shards, column), _CELL)
        self.candidates, self.anchors = deal(rows, self.rows, 0), deal(anchors, self.cols, 1)

    def all_of(self, column: str, shards: int):
        return F.explode(F.when(F.col(column).isNotNull(), F.array(column)).otherwise(F.sequence(F.lit(0), F.lit(shards - 1)))).alias(column)

    def search(self, schema: str, find, extra: DataFrame | None = None) -> DataFrame:
        sent = self.candidates.withColumn("kind", F.lit(0)).unionByName(self.anchors.withColumn("kind", F.lit(1)))
        sent = sent if extra is None else sent.unionByName(extra.withColumn("kind", F.lit(2)))
        cells = sent.select(self.all_of("cell_row", self.rows), "cell_col", "kind", "body").select("cell_row", self.all_of("cell_col", self.cols), "kind", "body")
        return cells.groupBy("cell_row", "cell_col").applyInArrow(lean_group(_cell(self.planes, self.words, schema, find)), schema)

    def ranges(self, positives: DataFrame) -> DataFrame:
        """Positives of anchors, in blocks that go where the anchors go."""
        shards = self.cols

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                columns = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "place", "positive_id", "positive_score")]
                shard = ((columns[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
                each = np.unique(shard)
                bodies = [pack(*(c[shard == s] for c in columns)) for s in each]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(each), pa.int32()), pa.array(each, pa.int32()), pa.array(bodies, pa.binary())], names=["cell_row", "cell_col", "body"])

        return positives.mapInArrow(lean(run), _CELL)


def hard_negatives(vectors: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, shard_rows: int = 1 << 16, shard_anchors: int = 1 << 12) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; an anchor's positives are its
    ``positives`` best rows of the same label, and a positive's negatives the ``negatives`` best
    rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    whole = integers(vectors, scale, scratch, where="vec_id IS NOT NULL AND label IS NOT NULL")
    if whole is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if 100 * whole.most**2 * max(whole.width, 1) >= 1 << 62:
        raise ValueError(f"components up to {whole.most / scale:.3g} have products beyond 62 bits")
    miner = Miner(whole, every, shard_rows, shard_anchors)
    near = _best(miner.search(_POSITIVE, _positives(positives)), ["anchor"], [F.desc("positive_score"), "positive_id", "row"], positives, miner.rows)
    pairs = scratch.keep(near.select("anchor", F.col("rank").cast("int").alias("place"), "positive_id", "positive_score"), "positives")
    far = miner.search(_NEGATIVE, _negatives(negatives, low, high), miner.ranges(pairs))
    best = _best(far, ["anchor", "place"], [F.desc("negative_score"), "negative_id", "row"], negatives, miner.rows)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(vectors.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")))


SQL = {
    "op12_hard_negatives": r"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS MATERIALIZED (
            SELECT a.row AS anchor, a.vec_id AS anchor_id, r.row, r.vec_id, a.label = r.label AS same,
                   list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM kept a JOIN kept r ON a.row <> r.row WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor, anchor_id, row AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5
        )
        SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, vec_id, row))::INTEGER AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scored s ON s.anchor = p.anchor AND NOT s.same
         AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """
}
