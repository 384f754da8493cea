"""Vector codes: product quantisation in whole numbers, screened in single precision.

Vectors are cut into parts; each part position has a codebook, fitted by rounds that
assign every part to its nearest entry and replace entries by the floor of their parts'
mean. All results are those of exact whole-number arithmetic, but most of the work is
one matrix product in single precision for a block of vectors:

* |x - c|^2 is |x|^2, equal for all entries, plus |c|^2 - 2 x.c. The product of n
  components, each rounded to single precision (u = 2^-24), is off by at most
  g |x| |c|, where g = (n + 2) u / (1 - (n + 2) u), in whatever order it is summed.
  That gives an interval of each entry's distance; a little more covers the double
  precision in which the interval itself is computed.
* An entry whose interval begins beyond the end of another's cannot be the nearest. Where
  one entry is left it is the nearest, and nothing else is computed.
* Entries whose intervals overlap the best are evaluated again in 64-bit integers, and
  ties go to the lower index.

Vectors are written once as whole numbers in packed blocks; a round is one pass over them,
of which a task sends the sums and counts of its parts, and the driver gets width * entries
sums. Sums are added as decimals, so they do not overflow. Labels' errors are summed within
tasks before they are shuffled, then joined to the codes.

Defined cases: vectors that are null or hold null or non-finite components take no part,
nor do those whose length is not the most common one (the smaller, if tied); a width that
the number of parts does not divide gives the first parts one component more; of equal
vec_ids all rows are coded, and the codebooks begin with the smallest vec_ids (nulls last,
then by vector); with fewer rows than entries the codebooks have as many entries as rows;
components so large that squared distances could exceed 62 bits are an error; without rows
the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean, unpack
from .integer_vectors import body, integers, packed

_CODED = "vec_id long, label long, code string, error long"
_UNIT = 2.0**-24


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest of ``entries`` to each row of ``x``, ties to the lower index, and how many distances were evaluated in integers."""
    n = x.shape[1] + 2
    bound = n * _UNIT / (1 - n * _UNIT)
    product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    squares = (entries.astype(np.float64) ** 2).sum(axis=1)
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * np.sqrt(squares)
    near = squares - 2 * product
    off = 2 * bound * norms * (1 + 2.0**-30) + (squares + 2 * norms) * n * 2.0**-50
    left = near - off <= (near + off).min(axis=1, keepdims=True)
    chosen = left.argmax(axis=1)
    unsure = np.flatnonzero(left.sum(axis=1) > 1)
    if not len(unsure):
        return chosen, 0
    at, entry = np.nonzero(left[unsure])
    exact = np.full((len(unsure), len(entries)), np.iinfo(np.int64).max)
    exact[at, entry] = ((x[unsure][at] - entries[entry]) ** 2).sum(axis=1)
    chosen[unsure] = exact.argmin(axis=1)
    return chosen, len(at)


def edges(width: int, parts: int) -> list[tuple[int, int]]:
    """Where parts begin and end; the first ones have a component more, if they are not equal."""
    ends = np.cumsum([width // parts + (p < width % parts) for p in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def _matrices(batches: Iterator[pa.RecordBatch], width: int):
    for b in batches:
        for data in b.column("body").to_pylist():
            _, ids, labels, v = unpack(data)
            yield ids, labels, v.reshape(-1, width)


def _sums(cuts: list[tuple[int, int]], books: list[np.ndarray]):
    """A task's sums of the parts of each entry, and how many they are."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for _, _, v in _matrices(batches, cuts[-1][1]):
            for p, (a, z) in enumerate(cuts):
                which, _ = nearest(v[:, a:z], books[p])
                order = np.argsort(which, kind="stable")
                used, first, n = np.unique(which[order], return_index=True, return_counts=True)
                sums[p][used] += np.add.reduceat(v[order, a:z], first, axis=0) if z > a else 0
                counts[p][used] += n
        at = [(p, e) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in at], pa.int32()), pa.array([e for _, e in at], pa.int32()), pa.array([counts[p][e] for p, e in at], pa.int64()), pa.array([sums[p][e].tolist() for p, e in at], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    return make


def _codes(cuts: list[tuple[int, int]], books: list[np.ndarray]):
    last = np.iinfo(np.int64).max

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, v in _matrices(batches, cuts[-1][1]):
            which = np.stack([nearest(v[:, a:z], books[p])[0] for p, (a, z) in enumerate(cuts)], axis=1)
            error = sum(((v[:, a:z] - books[p][which[:, p]]) ** 2).sum(axis=1) for p, (a, z) in enumerate(cuts))
            digits, long = which.astype(np.uint8).tobytes().hex(), 2 * len(cuts)
            codes = [digits[i : i + long] for i in range(0, len(digits), long)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == last), pa.array(labels, mask=labels == last), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return make


def fit(blocks: DataFrame, books: list[np.ndarray], cuts: list[tuple[int, int]], rounds: int) -> list[np.ndarray]:
    """Codebooks after so many rounds over all ``blocks``; entries that nothing uses stay."""
    for _ in range(rounds):
        sent = blocks.mapInArrow(lean(_sums(cuts, books)), "part int, entry int, n long, sums array<long>")
        each = sent.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
        summed = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        books = [b.copy() for b in books]
        for r in summed.collect():  # width * entries rows at most
            books[r["part"]][r["entry"], r["at"]] = int(r["x"]) // r["n"]
    return books


def compress(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part), error, label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "codes")
    whole = integers(vectors, scale, scratch)
    if whole is None:
        return spark.createDataFrame([], f"{_CODED}, label_error long, codebooks_sha256 string")
    if 4 * whole.most**2 * max(whole.width, 1) >= 1 << 62:
        raise ValueError(f"components up to {whole.most / scale:.3g} have squared distances beyond 62 bits")
    cuts = edges(whole.width, parts)
    first = np.array([r["v"] for r in whole.rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()], np.int64)
    blocks = scratch.keep(packed(whole.rows, whole.width, body, "body binary"), "blocks")
    books = fit(blocks, [first[:, a:z] for a, z in cuts], cuts, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    coded = scratch.keep(blocks.mapInArrow(lean(_codes(cuts, books)), _CODED), "coded")
    labels = scratch.keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    joined = coded.alias("c").join(labels.alias("l"), F.expr("c.label <=> l.label"))
    return joined.select("c.*", "l.label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        rf"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 4096)::BIGINT) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), sized AS MATERIALIZED (
            SELECT * FROM kept WHERE len(v) = (SELECT len(v) FROM kept GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        ), cut AS MATERIALIZED (
            SELECT row, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x FROM sized, range({parts}) t(p)
        ), first AS MATERIALIZED (
            SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM sized
        ), book0 AS MATERIALIZED (
            SELECT p, e, x AS c FROM cut JOIN first USING (row) WHERE e < {entries}
        )"""
    ]
    for k in range(rounds + 1):
        steps.append(
            rf"""near{k} AS MATERIALIZED (
            SELECT row, p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
            FROM cut JOIN book{k} USING (p) QUALIFY row_number() OVER (PARTITION BY row, p ORDER BY d, e) = 1
        )"""
        )
        if k < rounds:
            steps.append(
                rf"""sum{k} AS (
            SELECT p, e, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{k}, unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL
        ), mean{k} AS (
            SELECT p, e, list((((s - ((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM sum{k} GROUP BY ALL
        ), book{k + 1} AS MATERIALIZED (
            SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e
        )"""
            )
    return (
        ", ".join(steps)
        + rf""", coded AS (
            SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY row
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN sized USING (row)
    """
    )


SQL = {"op11_vector_codes": _sql()}
