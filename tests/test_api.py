"""The library's calls end to end on the inline code base."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from quarrylight import api, model
from quarrylight.operators import dashboard
from quarrylight.plans import fixtures
from quarrylight.sources import sinks
from quarrylight.sources.providers import hashing_embedding
from quarrylight.store.buckets import Store
from quarrylight.store.code_index import CodeIndex


def test_search_and_learn(spark):
    own = api.index(fixtures.code_files(spark))
    queries = spark.createDataFrame([(1, "Engine struct"), (2, "estimate plan print"), (3, "zzz")], "query_id long, text string")
    none = spark.createDataFrame([], model.ALIASES)
    got = api.search_context(own, queries, none).collect()
    assert {(r["query_id"], r["phase"]) for r in got} == {(1, 2), (2, 3)}
    known = api.learn_aliases(none, spark.createDataFrame(got), queries, F.lit(dt.datetime(2024, 1, 1)))
    again = api.search_context(own, queries, known).collect()
    assert {(r["query_id"], r["phase"]) for r in again} == {(1, 1), (2, 1)}


def test_refresh(spark):
    files = fixtures.code_files(spark)
    first = api.index(files)
    changed = files.where("path <> 'src/plan.py'").withColumn("content", F.when(F.col("path") == "cmd/server.go", "func other() {\n}\n// a\n").otherwise(F.col("content")))
    second, changes = api.refresh(first, changed)
    assert {r["path"]: r["status"] for r in changes.collect()} == {"src/plan.py": "deleted", "cmd/server.go": "changed"}
    assert {r["status"]: r["n"] for r in api.report(changes).collect()} == {"deleted": 1, "changed": 1}
    want = api.index(changed)
    for name in ("files", "symbols", "edges", "chunks", "symbol_terms", "chunk_terms"):
        a, b = getattr(second, name), getattr(want, name)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect())), name


def test_skills(spark):
    cols = "name string, relative_path string, title string, intent string, description string, triggers array<string>, action_triggers array<string>, micro_rules array<string>, keywords array<string>, content string"
    rows = [("python-testing", "s/py", "", "write tests", "", [], ["testing"], [], [], "unit tests in python"), ("sql-tuning", "s/sql", "", "tune", "", [], [], [], [], "query plans"), ("code-review", "s/rev", "", "review code", "", [], [], [], [], "review of tests")]
    own = spark.createDataFrame(rows, cols)
    tasks = spark.createDataFrame([(1, "review the tests")], "query_id long, text string")
    assert api.search_skills(own, tasks, languages=["rust"], techniques=["web"]).count() <= 2
    assert {r["name"] for r in api.search_skills(own, tasks, logit=None).collect()} >= {"code-review"}
    out = api.task_pipeline(own, "test the plan", files=fixtures.code_files(spark))
    assert set(out) == {"skills", "profile", "architecture", "split", "tree"} and out["architecture"].count() == 1
    assert api.search_docs(own, tasks).count() <= 3


def test_snapshots_and_notes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, v string")
    root = str(tmp_path / "t")
    assert sinks.latest_snapshot(spark, root) is None
    sinks.write_snapshot(rows, root, 1)
    sinks.write_snapshot(rows.withColumn("v", F.lit("b")), root, 2)
    assert sinks.latest_snapshot(spark, root).first()["v"] == "b"
    cache = spark.createDataFrame([], "content_hash string, vector array<float>")
    one = sinks.cached_vectors(rows, cache, "v", hashing_embedding)
    assert sinks.cached_vectors(rows, one, "v", hashing_embedding).count() == 1
    notes = spark.createDataFrame([(1, "env", "x", False)], model.LEARNINGS)
    sinks.write_learnings(notes, str(tmp_path / "notes"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "notes")).collect()] == ["# env", "- x"]


def test_task_pipeline_and_skill_lookups(spark):
    cols = "name string, relative_path string, title string, intent string, description string, triggers array<string>, action_triggers array<string>, micro_rules array<string>, keywords array<string>, content string"
    rows = [("test-plan", "skills/test-plan/SKILL.md", "", "plan tests", "", [], ["testing"], [], [], "plan the tests"), ("sql", "skills/sql/SKILL.md", "", "tune", "", [], ["query"], [], [], "x")]
    skills = spark.createDataFrame(rows, cols)
    files = fixtures.code_files(spark)
    vector = spark.createDataFrame([("plan the cost",)], "t string").select(hashing_embedding(F.col("t")).alias("v")).first()["v"]
    notes = spark.createDataFrame([(1, "env", "old", vector), (2, "env", "other", [-x for x in vector])], "ord long, category string, content string, vector array<float>")
    rules = spark.createDataFrame([("plan", "keep it simple"), ("build", "small steps")], "group string, rule string")
    got = api.task_pipeline(skills, "plan the cost", files=files, notes=notes, rules=rules)
    assert got["skills"].count() >= 1 and got["architecture"].count() == 1
    assert [r["path"] for r in got["tree"].collect()] == sorted(p for p, _ in fixtures.FILES)
    assert [r["content"] for r in got["notes"].collect()] == ["old"] and [r["rule"] for r in got["rules"].collect()] == ["keep it simple"]
    assert [r["name"] for r in api.list_skills(skills, "TEST").collect()] == ["test-plan"] and api.list_skills(skills).count() == 2
    assets = spark.createDataFrame([("workflows/release.md", "ship it"), ("workflows/sql.md", "no")], "path string, content string")
    assert api.get_skill(skills, assets, "sql").first()["origin"] == "skill" and api.get_skill(skills, assets, "release").first()["content"] == "ship it"
    assert api.get_skill(skills, assets, "none").count() == 0


def test_models_of_the_caller(spark):
    def load():
        def model(texts):
            assert len(texts) <= 4 and all(t.startswith("passage: ") for t in texts)
            return [[len(t), 1.0, 0.0] for t in texts]

        return model

    from quarrylight.sources.providers import model_embedding, model_logit

    df = spark.createDataFrame([(i, "x" * i if i % 5 else None) for i in range(30)], "id int, text string").repartition(2)
    got = {r["id"]: r["v"] for r in df.select("id", model_embedding(load, batch=4)(F.col("text")).alias("v")).collect()}
    for i, v in got.items():
        n = len("passage: ") + (i if i % 5 else 0)
        assert abs(v[0] - n / (n * n + 1) ** 0.5) < 1e-6 and abs(sum(x * x for x in v) - 1) < 1e-5
    pairs = spark.createDataFrame([("ab", "abc"), (None, "x")], "text string, content string")
    scored = model_logit(lambda: lambda a, b: [len(x) - len(y) for x, y in zip(a, b, strict=True)], batch=1)(pairs)
    assert sorted(r["logit"] for r in scored.collect()) == [-1.0, -1.0]


def test_sinks(spark, tmp_path):
    at = dt.datetime(2024, 5, 1, 12)
    ddl = "event_id long, ts timestamp, tool_name string, operation string, tokens_original long, tokens_optimized long, error_message string"

    def call(i, hours, tool="read"):
        return (i, at - dt.timedelta(hours=hours), tool, None, 100, 40, None)

    root = str(tmp_path / "usage")
    daily, kept = sinks.log_calls(spark.createDataFrame([call(1, 30), call(2, 1)], ddl), root, "first", F.lit(at))
    assert daily.count() == 2 and [r["event_id"] for r in kept.collect()] == [2]
    daily, kept = sinks.log_calls(spark.createDataFrame([call(3, 2), call(4, 1, "noop")], ddl), root, "second", F.lit(at), "noop")
    assert sum(r["calls"] for r in daily.collect()) == 4 and {r["event_id"] for r in kept.collect()} == {2, 3}
    again, same = sinks.log_calls(spark.createDataFrame([call(3, 2), call(4, 1, "noop")], ddl), root, "second", F.lit(at), "noop")
    assert sorted(map(str, again.collect())) == sorted(map(str, daily.collect())) and same.count() == 2  # the batch is in the ledger
    later, _ = sinks.log_calls(spark.createDataFrame([call(5, 0)], ddl), root, "third", F.lit(at))
    old, new = (Store(spark, root, v) for v in (2, 3))
    assert {b for b, f in new.tables["daily"].at.items() if old.tables["daily"].at.get(b) != f} == set(new.buckets_of("daily", later.where("day = DATE'2024-05-01'").select("day")))
    sessions = spark.createDataFrame([("a", "Plan"), ("b", "Fix")], "session_id string, stage string")
    sinks.write_sessions(sessions, str(tmp_path / "sessions"))
    sinks.write_sessions(spark.createDataFrame([("a", "Build")], "session_id string, stage string"), str(tmp_path / "sessions"))
    own = spark.read.schema("session_id string, stage string").json(str(tmp_path / "sessions"))
    assert {(r["session_id"], r["stage"]) for r in own.collect()} == {("a", "Build"), ("b", "Fix")}
    catalog = spark.createDataFrame([("one", "x"), ("two", "y")], "name string, content string")
    vectors = spark.createDataFrame([("one", [1.0, 0.0]), ("two", [0.0, 1.0])], "id string, vector array<float>")
    sinks.write_vectors(vectors, catalog, str(tmp_path / "vectors"), 3)
    assert sinks.current_vectors(spark, catalog, str(tmp_path / "vectors"), 3).count() == 2
    assert sinks.current_vectors(spark, catalog.withColumn("content", F.lit("z")), str(tmp_path / "vectors"), 3) is None
    chunk = spark.createDataFrame([(1, "old"), (2, "stays")], "id long, text string")
    sinks.append_chunks(chunk, str(tmp_path / "chunks"))
    after = sinks.append_chunks(spark.createDataFrame([(1, "new"), (3, "more")], "id long, text string"), str(tmp_path / "chunks"))
    assert {(r["id"], r["text"]) for r in after.collect()} == {(1, "new"), (2, "stays"), (3, "more")}


def test_stored_index_is_searched_alike(spark, tmp_path):
    files = fixtures.code_files(spark)
    queries = spark.createDataFrame([(1, "Engine struct"), (2, "estimate plan print"), (3, "zzz")], "query_id long, text string")
    none = spark.createDataFrame([], model.ALIASES)
    rows = lambda own: sorted(map(str, api.search_context(own, queries, none).collect()))
    assert rows(CodeIndex.build(spark, str(tmp_path / "s"), files, buckets=4)) == rows(api.index(files)) != []


def test_dashboard(spark):
    at = dt.datetime(2024, 5, 10, 12, 30)
    ago = lambda hours: at - dt.timedelta(hours=hours)
    calls = spark.createDataFrame(
        [(ago(1), "read", "full", 100, 40, 7, None), (ago(1), "read", "full", 50, 60, None, "bad"), (ago(2), "search", None, 10, 0, 1, None), (ago(30), "read", None, 1000, 0, 1, None), (ago(1), "mcp_tool", None, 9, 9, 9, None)],
        "ts timestamp, tool_name string, operation string, tokens_original long, tokens_optimized long, duration_ms long, error_message string",
    )
    loads = spark.createDataFrame([(ago(i), f"s{i % 3}") for i in range(12)] + [(ago(900), "old")], "ts timestamp, skill_id string")
    embeds, models = (spark.createDataFrame([(ago(i), f"q{i}") for i in span], "ts timestamp, query_text string") for span in ((1, 50), (3,)))
    rollup = dashboard.days(calls.where("tool_name <> 'mcp_tool'"), loads, embeds, models)
    rows = dashboard.sections(calls, loads, embeds, models, rollup, F.lit(at))
    got = {(r["section"], r["place"]): r for r in rows.collect()}
    day = got["past_24h", 1]
    assert (day["tool_calls"], day["skills_loaded"], day["embed_queries"], day["model_queries"], day["saved"], day["saved_percent"]) == (3, 12, 1, 1, 60, 37.5)
    assert [got[s, 1]["tool_calls"] for s in ("last_7d", "last_30d", "lifetime")] == [4, 4, 4] and [got[s, 1]["skills_loaded"] for s in ("last_7d", "last_30d", "lifetime")] == [12, 12, 13]
    assert [(got["tool_breakdown", i]["label"], got["tool_breakdown", i]["tool_calls"]) for i in (1, 2)] == [("read", 2), ("search", 1)]
    assert sum(k[0] == "recent_skill_calls" for k in got) == 10 and [got["top_skills", i]["label"] for i in (1, 2, 3)] == ["s0", "s1", "s2"]
    assert [got["recent_actions", i]["duration_ms"] for i in (1, 2, 3)] == [0, 7, 1] and got["recent_actions", 1]["error_message"] == "bad"
    hours = [got["hourly_savings", i] for i in range(1, 25)]
    assert [(h["label"], h["tokens_original"], h["saved"]) for h in hours[-3:]] == [("10:00", 10, 10), ("11:00", 150, 50), ("12:00", 0, 0)] and hours[0]["label"] == "13:00"
    assert got["embed_recent", 1]["label"] == "q1" and ("embed_recent", 2) not in got
    text = json.loads(dashboard.document(rows).first()["stats"])
    assert len(text) == 10 and text["hourly_savings"][22]["saved"] == 50 and text["lifetime"][0]["tokens_original"] == 1160
    none = [x.limit(0) for x in (calls, loads, embeds, models)]
    empty = {(r["section"], r["place"]): r for r in dashboard.sections(*none, dashboard.days(*none), F.lit(at)).collect()}
    assert len(empty) == 28 and empty["lifetime", 1]["tool_calls"] == 0 and empty["past_24h", 1]["saved_percent"] == 0.0


def test_read_document(spark):
    text = "intro\n# One\nthe red fox  \n\n\nruns\n# Two\nblue sea\n# Three\nred red fox\n# Four\nnothing"
    docs = spark.createDataFrame([(1, text), (2, "# A\nred"), (3, None)], "doc_id long, text string")
    by = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    close = by(api.read_document(docs, "red fox", 2))
    parts = close[1].split("\n\n---\n\n")
    assert len(parts) == 2 and {p.split(" (")[0] for p in parts} == {"#### One", "#### Three"} and parts[0].startswith("#### Three (Relevance: ") and close[2] == "# A\nred" and close[3] == ""
    first = by(api.read_document(docs, "RED", 1, None))
    assert first[1] == "#### One\nthe red fox\n\nruns" and by(api.read_document(docs, "absent", 1, None))[1] == by(api.read_document(docs, "  ", 1))[1] == text.replace("  \n\n\n", "\n\n")
