"""Vectors in cells against the exact scan."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators.vector_search import batch_top_k
from quarrylight.store.vector_cells import VectorCells


def ranks(df):
    return {(r["query_id"], r["rank"], r["id"]): round(r["score"], 9) for r in df.collect()}


def test_cells(spark, tmp_path, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = vectors.where("id % 10 = 0").select(F.col("id").alias("query_id"), "vector")
    exact = ranks(batch_top_k(vectors, queries, 10))
    own = VectorCells.build(spark, str(tmp_path / "v"), vectors, cells=20, rounds=5)
    assert own.store.read("vectors").count() == vectors.count()
    assert ranks(own.search(queries, 10, probes=20)) == exact  # all cells
    got, asked = ranks(own.search(queries, 10, probes=14)), own.asked(queries, 14)
    found = {(q, i) for q, _, i in got}  # the vectors are nearly uniform, so neighbours are in many cells
    assert len(found & {(q, i) for q, _, i in exact}) >= 0.9 * len(exact)
    sizes = {r["cell"]: r["count"] for r in own.store.read("vectors").groupBy("cell").count().collect()}
    read = sum(sizes.get(r["cell"], 0) for r in asked.collect())
    assert asked.count() == 14 * queries.count() and read < 0.8 * vectors.count() * queries.count()
    with pytest.raises(ValueError, match="version"):
        VectorCells.build(spark, str(tmp_path / "v"), vectors)


def test_awkward_vectors_and_changes(spark, tmp_path):
    rng = np.random.default_rng(3)
    near = [(i, (np.r_[1.0, 0, 0, 0] + 0.01 * rng.normal(size=4)).tolist()) for i in range(40)]
    far = [(100 + i, (np.r_[0, 0, 0, 1.0] + 0.01 * rng.normal(size=4)).tolist()) for i in range(40)]
    odd = [(900, None), (901, []), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [1.0, None, 0.0, 0.0]), (904, [1.0]), (905, [0.0] * 4), (906, [float("inf")] * 4), *[(950 + i, near[0][1]) for i in range(30)]]
    schema = "id long, vector array<double>"
    vectors = spark.createDataFrame([*near, *far, *odd], schema)
    own = VectorCells.build(spark, str(tmp_path / "v"), vectors, cells=4)
    stored = {r["id"] for r in own.store.read("vectors").collect()}
    assert stored == {i for i, _ in [*near, *far, *odd]} - {900, 901, 902, 903, 904, 906}
    queries = spark.createDataFrame([(0, near[0][1]), (7, None)], "query_id long, vector array<double>")
    best = own.search(queries, 5, probes=1).orderBy("rank").collect()
    assert [r["id"] for r in best] == [950, 951, 952, 953, 954] and {r["query_id"] for r in best} == {0}
    after = own.with_rows(spark.createDataFrame([(950, far[0][1]), (5000, near[0][1])], schema), spark.createDataFrame([(951,)], "id long"))
    assert [r["id"] for r in after.search(queries, 3, probes=1).orderBy("rank").collect()] == [952, 953, 954]
    assert after.search(queries, 200, probes=4).where("id IN (951)").count() == 0 and after.search(queries, 200, probes=4).where("id = 5000").count() == 1
    assert VectorCells(own.store).search(queries, 1, probes=1).first()["id"] == 950
    with pytest.raises(ValueError, match="no vectors"):
        VectorCells.build(spark, str(tmp_path / "w"), vectors.limit(0))
