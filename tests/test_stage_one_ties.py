"""The first stage over many skills of few names: what it scores does not grow with the skills that tie."""

from __future__ import annotations

from quarrylight.operators import ranking
from tests.test_candidates import SKILLS, all_pairs


def test_ties_are_settled_before_rows_are_joined(spark):
    names = [f"{a} {b}" for a in ("small", "large", "red") for b in ("ring", "bolt")]
    rows = [(f"{n.replace(' ', '-')}-{i}", "p", "", n, f"LARGE {n}", [f"b{i % 4}"], ["LARGE"], n.split(), ["x"], f"{n} {i % 5}") for i in range(150) for n in names]
    skills = spark.createDataFrame(rows, SKILLS)
    tasks = spark.createDataFrame(list(enumerate([*names, "", "ring"])), "query_id long, text string")
    n = ranking.lexical_candidates(skills, tasks, 4).count()
    assert 4 * 8 <= n <= 4 * 8 * 4
    got, want = (sorted((r["query_id"], r["rank"], r["name"], r["score"]) for r in f(skills, tasks, 4).collect()) for f in (ranking.stage_one, all_pairs))
    assert got == want
