"""Joins on substrings and exact first stages against all pairs, with what they compare counted."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarrylight import model
from quarrylight.operators import aliases, containment, ranking

SKILLS = "name string, relative_path string, title string, intent string, description string, triggers array<string>, action_triggers array<string>, micro_rules array<string>, keywords array<string>, content string"


def test_contained(spark):
    rng = random.Random(1)
    letters = "abcdé "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    parts = ["", None, "a", "ab", "abc", "zzz", "dé a", *(text(rng.randint(1, 12)) for _ in range(200))]
    wholes = {i: text(rng.randint(0, 60)) for i in range(150)} | {900: "", 901: None, 902: parts[-1], 903: "xyz" + parts[-1] + "xyz"}
    p = spark.createDataFrame([(x,) for x in parts], "part string")
    w = spark.createDataFrame(list(wholes.items()), "key long, whole string")
    got = [tuple(r) for r in containment.contained(p, w).select("key", "part").collect()]
    want = {(k, x) for k, t in wholes.items() if t is not None for x in set(parts) if x is not None and x in t}
    assert set(got) == want and len(got) == len(want)
    assert containment.contained(p.limit(0), w).count() == 0 and containment.contained(p, w.limit(0)).count() == 0


def test_few_are_compared(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 10))) for _ in range(3000)]
    parts = spark.createDataFrame([(" ".join(rng.sample(words, 2)),) for _ in range(1000)] + [(x,) for x in words[:500]], "part string")
    wholes = spark.createDataFrame([(i, " ".join(rng.choices(words, k=30))) for i in range(1000)], "key long, whole string")
    n, found = containment.candidates(parts, wholes).count(), containment.contained(parts, wholes).count()
    assert 4000 < found and n < 2 * found < 0.02 * 1500 * 1000


def random_skills(rng, n, vocabulary):
    some = lambda k: " ".join(rng.choices(vocabulary, k=k))
    return [(some(2).replace(" ", "-"), f"p/{i}", "", some(3), some(5), [some(1)], [some(1)], [some(2)], [some(1)], some(12)) for i in range(n)]


def all_pairs(skills, tasks, k):
    scored = ranking.spread(skills, tasks).withColumn("score", ranking.lexical_score(F.col("text")))
    kept = scored.where((F.col("score") > 0) | (F.trim("text") == ""))
    return kept.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name)")).where(F.col("rank") <= k)


def test_stage_one_is_exact(spark):
    """Common words, rare words, whole names, repeats, blanks and words that nothing has."""
    rng = random.Random(4)
    vocabulary = ["the", "of", "a", *(f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnrst")]
    rows = random_skills(rng, 300, [*vocabulary, *["the"] * 60, *["of"] * 30])
    texts = ["the", "of the", "a", "", "  ", "absent", rows[5][0], rows[6][3], "The THE bal", "bal bel bil", " ".join(rng.choices(vocabulary, k=12)), None]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(60)] + ["the"]
    skills = spark.createDataFrame([*rows, rows[0]], SKILLS).withColumn("content", F.when(F.col("relative_path") != "p/3", F.col("content")))
    tasks = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    for k in (1, 7):
        got, want = (sorted((r["query_id"], r["rank"], r["name"], r["score"]) for r in f(skills, tasks, k).collect()) for f in (ranking.stage_one, all_pairs))
        assert got == want
    assert ranking.stage_one(skills, tasks, 7).columns == [*skills.columns, *tasks.columns, "score", "rank"]


def test_stage_one_looks_at_few(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}{d}" for a in "bcdfgk" for b in "aeiou" for c in "lmnrst" for d in "aeiou"]
    skills = spark.createDataFrame(random_skills(rng, 1500, [*vocabulary, *["common"] * 500]), SKILLS)
    tasks = spark.createDataFrame([(i, "common " + " ".join(rng.choices(vocabulary, k=2))) for i in range(200)] + [(999, "common")], "query_id long, text string")
    n = ranking.lexical_candidates(skills, tasks, 8).count()
    assert 201 * 8 <= n < 0.08 * 1500 * 201


def test_alias_batch(spark):
    rng = random.Random(6)
    words = ["auth", "login", "Straße", "db", "x", "session store", "the whole text of a query"]
    known = [(rng.choice(words) + rng.choice(["", " page", "2"]), f"f{rng.randint(0, 9)}.rs", None, None, 1, rng.choice([0.5, 0.8, 1.0]), None, None) for _ in range(80)] + [("", "any.rs", None, None, 1, 0.1, None, None)]
    asked = [(i, t) for i, t in enumerate(["AUTH", "fix the login page", "straße2 db", "", " \t", "nothing", "session", "x", None, "auth"])]
    own, queries = spark.createDataFrame(known, model.ALIASES), spark.createDataFrame(asked, "query_id long, text string")
    want = {}
    for q, t in asked:
        for term, path, *_, confidence, _, _ in known if t and t.strip() else []:
            if term.lower() in t.lower() or t.lower() in term.lower():
                want[q, path] = max(confidence, want.get((q, path), 0))
    assert {(r["query_id"], r["resolved_path"]): r["confidence"] for r in aliases.lookup_batch(own, queries).collect()} == want
