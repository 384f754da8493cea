"""Connected components of an edge table by contraction, without collecting anything.

Each round every node points at the smallest of itself and its neighbours, chains of
pointers are halved until they are flat, and edges are carried over to the nodes
pointed at. A round at least halves the nodes that still have edges. All tables
between rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gathered


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: columns a, b (long). Returns node, root for every node with an edge; root is the smallest node reached."""
    edges = scratch.keep(edges.where("a <> b").select("a", "b").distinct(), "edges")
    levels: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        return scratch.keep(gathered(df, 2 * n, 50_000), name)

    while n := edges.count():
        both = edges.union(edges.select("b", "a"))
        points = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        points = kept(points, "points")
        while True:
            up = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = kept(points.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "points")
            points = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        levels.append(points)
        left = points.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = points.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = kept(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[0]
    for level in levels[1:]:
        step = level.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return scratch.keep(out, "components") if len(levels) > 1 else out
