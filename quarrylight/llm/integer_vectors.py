"""Vectors as whole numbers, checked, numbered and packed into blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, pack


@dataclass(frozen=True)
class Vectors:
    """rows: row (a number of its own), vec_id, label, v (whole numbers); count of them; width of all; most: largest magnitude."""

    rows: DataFrame
    count: int
    width: int
    most: int


def integers(vectors: DataFrame, scale: int, scratch: Scratch, where: str = "true") -> Vectors | None:
    """floor(scale * x) of each component, of rows that have all components finite and fulfil ``where``.

    Of several lengths, only the most common takes part (the smaller, if tied). None if no
    row is left. Rows are written, so that their numbers stay what they are.
    """
    raw = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), vectors["embedding"].cast("array<double>").alias("x"))
    bad = "x IS NULL OR exists(x, y -> y IS NULL OR isnan(y) OR abs(y) = double('infinity'))"
    whole = raw.where(f"NOT coalesce({bad}, true) AND {where}").select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.expr(f"transform(x, y -> floor(y * {scale}D))").alias("v"))
    kept = scratch.keep(whole, "integers")
    magnitude = F.max(F.expr("coalesce(array_max(transform(v, y -> greatest(y, -(y + 1)))), 0L)")).alias("most")
    top = kept.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("rows"), magnitude).orderBy(F.desc("rows"), "width").first()
    return top and Vectors(kept.where(F.size("v") == top["width"]), top["rows"], top["width"], top["most"] + 1)


def arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, vec_id and label with their nulls as the largest number, and the vectors as rows of a matrix."""
    last = np.iinfo(np.int64).max
    plain = [batch.column(c).fill_null(last).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label")]
    return *plain, batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def packed(rows: DataFrame, width: int, make: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[tuple]], schema: str, block: int = 4096) -> DataFrame:
    """What ``make`` gives for the arrays of each block of rows."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = [pa.binary() if f.endswith("binary") else pa.int32() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                out = make(*arrays(b.slice(at, block), width))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)

    return rows.mapInArrow(lean(run), schema)


def body(row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, v: np.ndarray) -> list[tuple]:
    return [(pack(row, vec_id, label, v.ravel()),)]
