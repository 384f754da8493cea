"""Of a common term's units, a search sends on what the rarest term of a query leaves."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarrylight.store.buckets import Store
from quarrylight.store.fulltext import FullText


def test_long_lists_stay_where_they_lie(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(["common", f"rare{i % 70}", *(f"w{k}" for k in range(8) if rng.random() < 0.7)])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    change = Store(spark, str(tmp_path)).change()
    FullText(change.before, "docs", ["doc_id"], 2).add(change, docs, F.col("text"))
    asked = {q: {"common", f"rare{q}", f"w{q % 8}", f"w{q % 5}"} for q in range(70)} | {900: {"common", "w1"}, 901: {"w2"}, 902: {"common", "absent"}}
    terms = spark.createDataFrame([(q, t) for q, own in asked.items() for t in own], "query_id long, term string")
    found = FullText(change.commit(), "docs", ["doc_id"]).match(terms)
    got = sorted((r["query_id"], r["doc_id"]) for r in found.collect())
    assert got == sorted((q, i) for q, own in asked.items() for i, text in rows if own <= set(text.split()))
    assert "collect_list(struct(n" not in found._jdf.queryExecution().optimizedPlan().toString()
