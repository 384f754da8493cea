"""Aliases, merges, usage, graphs, learnings on hand-made cases."""

from __future__ import annotations

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from quarrylight import model
from quarrylight.operators import aliases, chunks, code, documents, graph, learnings, merge, ranking, search, usage
from quarrylight.plans import fixtures
from quarrylight.sources import files, providers, tree
from quarrylight.streaming import usage as streaming

NOW = dt.datetime(2024, 6, 1)


def alias(term, path, conf=0.8, hits=1, age=0, symbol=None, line=None):
    at = NOW - dt.timedelta(seconds=age)
    return (term, path, symbol, line, hits, conf, at, at)


def test_alias_upsert(spark):
    old = spark.createDataFrame([alias("auth", "a.rs", symbol="s", line=3)], model.ALIASES)
    seen = [("auth", "a.rs", None, None, NOW), ("auth", "a.rs", "t", None, NOW), ("new", "b.rs", None, 1, NOW)]
    batch = spark.createDataFrame(seen, "alias_term string, resolved_path string, resolved_symbol string, resolved_line int, observed_at timestamp")
    got = {r["alias_term"]: r for r in aliases.upsert(old, batch).collect()}
    assert (got["auth"]["hit_count"], got["auth"]["resolved_symbol"], got["auth"]["resolved_line"]) == (3, "t", 3)
    assert got["auth"]["confidence"] == pytest.approx(0.9)
    assert (got["new"]["hit_count"], got["new"]["confidence"]) == (1, 0.8)


def test_alias_lookup_and_decay(spark):
    day = 86400
    rows = [alias("auth flow", "a"), alias("đăng nhập", "b"), alias("k1", "c", conf=0.1, age=31 * day), alias("k2", "d", age=30 * day), alias("k3", "e", age=30 * day + 1), alias("k4", "f", age=90 * day), alias("k5", "g", age=90 * day + 1), alias("k6", "h", conf=0.15, age=31 * day)]
    df = spark.createDataFrame(rows, model.ALIASES)
    assert [r["resolved_path"] for r in aliases.lookup(df, "AUTH").collect()] == ["a"]
    assert [r["resolved_path"] for r in aliases.lookup(df, "mở đăng nhập").collect()] == ["b"]
    left = {r["alias_term"]: r["confidence"] for r in aliases.decay(df, F.lit(NOW)).collect()}
    assert "k5" not in left
    assert (left["k1"], left["k2"], left["k3"], left["k4"], left["k6"]) == (0.1, 0.8, 0.4, 0.4, 0.1)


def test_merge(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", "1")], "path string, content_hash string")
    b = spark.createDataFrame([("p", "1"), ("q", "2"), ("s", "1")], "path string, content_hash string")
    assert {r["path"]: r["status"] for r in merge.diff(a, b).collect()} == {"p": "same", "q": "changed", "r": "deleted", "s": "added"}
    rows = spark.createDataFrame([("q", 1), ("r", 2)], "file_path string, v int")
    assert [r["file_path"] for r in merge.without_paths(rows, b.where("path = 'q'")).collect()] == ["r"]
    sessions = spark.createDataFrame([(f"s{i:03d}", NOW - dt.timedelta(days=i % 40)) for i in range(150)], "session_id string, modified_at timestamp")
    kept = merge.session_gc(sessions, F.lit(NOW))
    assert kept.count() == 100
    pairs = spark.createDataFrame([(1, "a\nb\nb", "a\nc\nc\nc")], "k int, x string, y string")
    assert merge.line_delta(pairs, "k", "x", "y").first()[1:] == (3, 2)


def test_usage_edges(spark):
    rows = [(1, NOW, "t", None, 0, 0, None), (2, NOW - dt.timedelta(hours=24), "t", None, 100, 150, "bad"), (3, NOW - dt.timedelta(hours=24, seconds=1), "u", "o", 10, 5, None)]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp, tool_name string, operation string, tokens_original long, tokens_optimized long, error_message string")
    day = usage.trailing_day(ev, F.lit(NOW)).first()
    assert (day["calls"], day["saved"], day["saved_percent"]) == (2, -50, -50.0)
    top = usage.tool_breakdown(ev).first()
    assert (top["tool_name"], top["operation"], top["calls"], top["errors"]) == ("t", None, 2, 1)
    spine = usage.hourly_spine(ev, F.lit(NOW)).orderBy("hour").collect()
    assert len(spine) == 24 and sum(r["tokens_original"] for r in spine) == 0
    assert usage.retain(ev, F.lit(NOW), "u").count() == 2


def test_graph(spark):
    edges = [(f"f{i}", t) for t, n in (("two", 2), ("three", 3), ("eight", 8), ("nine", 9)) for i in range(n)] + [("two", "two"), ("f0", "two")]
    df = spark.createDataFrame(edges, "source string, target string")
    assert {r["target"]: r["level"] for r in graph.risk(df).collect()} == {"two": "Low", "three": "Medium", "eight": "Medium", "nine": "High"}


def test_code(spark):
    own = fixtures.code_files(spark)
    names = {(r["kind"], r["name"]) for r in code.symbols(own).collect()}
    assert {("struct", "Engine"), ("function", "open"), ("class", "Plan"), ("interface", "Row"), ("constant", "LIMIT"), ("function", "main")} <= names
    assert {r["target_name"] for r in code.import_edges(own).collect()} >= {"std::collections::HashMap", "os", "pathlib"}
    calls = {(r["file_path"], r["target_name"]) for r in code.call_edges(own).collect()}
    assert ("src/engine.rs", "cost") in calls and ("web/view.ts", "show") in calls
    outline = {r["path"]: r["skeleton"] for r in code.skeletons(own).collect()}
    assert "return 0" not in outline["src/engine.rs"] and "    fn run(&self, plan: &str) -> u64 { /* L16-21: 6 lines */ }" in outline["src/engine.rs"].split("\n")
    assert outline["cmd/server.go"] == fixtures.SERVER and outline["notes/empty.txt"] == ""
    assert code.target_symbols(own, "fn run").first()["snippet"].count("\n") == 5
    assert code.target_symbols(own, "absent").count() == 0
    raw = code.call_edges(own).select("file_path", "line", "target_name", "edge_type")
    assert graph.resolve_edges(raw, code.symbols(own)).count() > 0


def test_white_space(spark):
    """Tabs and wide spaces before a declaration; line ends other than line feeds stay inside lines."""
    text = "\tfn foo() {\n\u00a0\u2003def bar(x):\n\timport os\n\t\n \u3000\n\x0c\x0bclass A\x85\u2028B {\n\t\tfoo(bar(1))"
    own = spark.createDataFrame([("a.py", text)], "path string, content string")
    assert [(r["kind"], r["name"], r["start_line"]) for r in code.symbols(own).orderBy("start_line").collect()] == [("function", "foo", 1), ("function", "bar", 2), ("class", "A", 6)]
    assert [r["target_name"] for r in code.import_edges(own).collect()] == ["os"]
    assert [r["entry"] for r in code.listing(own).orderBy("line_no").collect()][:2] == ["L0001: fn foo() {", "L0002: def bar(x):"]
    assert {(r["line"], r["target_name"]) for r in code.call_edges(own).collect()} == {(7, "foo"), (7, "bar")}
    docs = spark.createDataFrame([(1, "\t\n \t\n\u3000"), (2, "a\n\tb\nc\n\t")], "doc_id long, text string")
    assert [(r["doc_id"], r["n_filled"]) for r in chunks.chunk_windows(docs).collect()] == [(2, 3)]
    assert [r["snippet"] for r in chunks.line_references(docs, "b").collect()] == ["b"]


def test_calls_equal_the_nested_loop(spark):
    rng = random.Random(3)
    names = [f"n{i}" if i % 3 else f"get_n{i}" for i in range(500)]
    lines = [f"fn {n}() {{" for n in names] + [" ".join(f"{rng.choice(['', 'x_', '9', 'é'])}{rng.choice(names)}{rng.choice(['(', ' (', '', '('])}1)" for _ in range(4)) for _ in range(4500)]
    rng.shuffle(lines)
    starts = {(k, n) for k, x in enumerate(lines, 1) for n in names if x == f"fn {n}() {{"}
    want = {(k, n) for k, x in enumerate(lines, 1) for n in names if n + "(" in x and (k, n) not in starts}
    own = spark.createDataFrame([("a.rs", "\n".join(lines))], "path string, content string")
    got = code.call_edges(own).collect()
    assert {(r["line"], r["target_name"]) for r in got} == want and len(got) == len(want) > 5000


def test_outlines(spark):
    filler = [f"let x{i} = {i};" for i in range(16)]
    cases = {
        "many lines": ["fn a(", "  x: int,", ") -> y", "{", "  if z {", "  }", "}", "pub x"],
        "one line": ["fn a() { b }", "c", "fn d() {}", "fn e() {", "}"],
        "never closed": ["fn a() {", "  {", "}"],
        "no block": ["fn a", "b"],
        "nested": ["fn a() {", "  fn b() {", "  }", "}", "fn c() {", "}"],
        "closed at once": ["fn a() {", "}}}", "fn b() {", "}"],
        "colon": ["def f(", "    x):", "    return 1", "def g():"],
    }
    df = spark.createDataFrame([(k, "\n".join(filler + v)) for k, v in cases.items()], "path string, content string")
    got = {r["path"]: r["skeleton"].split("\n")[1:] for r in code.skeletons(df).collect()}
    assert got["many lines"] == ["fn a(   x: int, ) -> y { /* L17-23: 7 lines */ }", "pub x"]
    assert got["one line"] == ["fn a() { /* L17-18: 2 lines */ }", "fn d() { /* L19-21: 3 lines */ }"]
    assert got["never closed"] == ["fn a() { /* L17-20: 4 lines */ }"] and got["no block"] == ["fn a b /* L17: implementation */"]
    assert got["nested"] == ["fn a() { /* L17-20: 4 lines */ }", "fn c() { /* L21-22: 2 lines */ }"]
    assert got["closed at once"] == ["fn a() { /* L17-18: 2 lines */ }", "fn b() { /* L19-20: 2 lines */ }"]
    assert got["colon"] == ["def f(     x): /* L17: implementation */", "def g(): /* L20: implementation */"]


def test_sections(spark):
    text = "intro\n# One\nbody a\nbody b\n## Empty\n### Two\nneedle"
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, "")], "doc_id long, text string")
    own = documents.section_split(docs)
    assert [(r["doc_id"], r["title"], r["body"]) for r in own.orderBy("doc_id", "section").collect()] == [(1, "Overview", "intro"), (1, "One", "body a\nbody b"), (1, "Two", "needle"), (2, "Overview", "plain")]
    assert [r["title"] for r in documents.section_slice(own.where("doc_id = 1"), "needle", 1).collect()] == ["Two"]


def test_semantic(spark):
    text = "---\ndescription: Plans work. Then more.\ntags: [a, 'b']\n---\n# Planner\n## When to use\n- start\n* later\n## Rules\n- keep it short\n"
    own = documents.semantic_documents(spark.createDataFrame([("planner-x", text)], "name string, content string"))
    r = own.first()
    assert (r["title"], r["intent"], r["triggers"], r["micro_rules"], r["keywords"]) == ("Planner", "Plans work", ["start", "later"], ["keep it short"], ["a", "b", "planner"])
    assert r["action_triggers"] == ["planner"] and r["applicable_phases"] == ["plan", "review"] and r["file_patterns"] == []
    assert r["summary_snippet"] == "Skill: planner-x (Planner)\nIntent: Plans work\nKey Rules: keep it short\nTriggers: start; later\nActions: planner"
    bare = documents.semantic_documents(spark.createDataFrame([("sql_notes-two", "## Rules\n- " + "x" * 2000 + "\n- use parameters\n"), ("empty", None)], "name string, content string"))
    got = {r["name"]: r for r in bare.collect()}
    assert got["sql_notes-two"]["intent"] == "sql_notes two" and got["sql_notes-two"]["micro_rules"] == ["use parameters"]
    assert "*.sql" in got["sql_notes-two"]["file_patterns"] and "query" in got["sql_notes-two"]["keywords"] and len(got["sql_notes-two"]["summary_snippet"]) <= 1500
    assert got["empty"]["applicable_phases"] == ["implement", "refactor"]


def test_learnings(spark):
    rows = [(i, "env", f"pinned {i}", True) for i in range(2)] + [(i, "env", f"note {i}", False) for i in range(2, 32)]
    old = spark.createDataFrame(rows, model.LEARNINGS)
    new = spark.createDataFrame([(40, "env", "NOTE 5", False), (41, "env", "fresh", False), (42, "env", "other", False)], model.LEARNINGS)
    got = learnings.add(old, new)
    assert got.count() == 32 and got.where("is_pinned").count() == 2 and got.where("content = 'note 2'").count() == 0
    assert [r["entry"] for r in learnings.for_category(old, "set up the env", 1).collect()] == ["- [env] note 31"]
    text = learnings.render(old.where("ord IN (1, 2, 3)")).first()["text"]
    assert text == "# PINNED:env\n- pinned 1\n# env\n- note 2\n- note 3"
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(("- loose\n" + text).split("\n"))], "line_no int, line string")
    assert [(r["category"], r["is_pinned"]) for r in learnings.parse(lines).orderBy("ord").collect()] == [("general", False), ("env", True), ("env", False), ("env", False)]


def test_learnings_see_those_before_them(spark):
    """Random batches with repeats and close entries inside one batch, for two lists, against a plain loop."""
    rng = random.Random(8)
    angle = lambda a: [math.cos(a), math.sin(a)]
    schema = "owner string, ord long, category string, content string, is_pinned boolean, vector array<double>"

    def some(owner, first, n):
        return [(owner, first + i, rng.choice(["env", "arch", " "]), rng.choice(["Note ", "note "]) + str(rng.randint(0, 25)), rng.random() < 0.1, angle(rng.random() * 6)) for i in range(n)]

    old = [x for o in ("a", "b") for x in some(o, 0, 3)]
    old = [(o, i, c.strip() or "general", t + f" old{i}", p, v) for o, i, c, t, p, v in old]
    new = [x for o in ("a", "b", "c") for x in some(o, 10, 40)] + [("a", 99, "env", "  ", False, None)]

    def plain(owner):
        items = [list(x) for x in old if x[0] == owner]
        for o, i, c, t, p, v in (x for x in new if x[0] == owner):
            c, t, hit = c.strip() or "general", t.strip(), None
            if not t:
                continue
            for x in items:
                if x[2] == c and x[3].lower() == t.lower():
                    hit = x
                    break
            else:
                for x in list(reversed(items))[:5]:
                    if x[2] == c and sum(a * b for a, b in zip(x[5], v, strict=True)) >= 0.995:
                        hit, x[3], x[5] = x, t, v
                        break
            if hit:
                hit[4] = hit[4] or p
                continue
            items.append([o, max(i, items[-1][1] + 1 if items else i), c, t, p, v])
            loose = [x for x in items if not x[4]]
            if len(loose) > 12:
                items.remove(loose[0])
        return items

    got = learnings.add(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), cap=12, look_back=5, threshold=0.995)
    want = sorted((x[0], x[1], x[2], x[3], x[4]) for o in "abc" for x in plain(o))
    assert sorted(tuple(r)[:5] for r in got.collect()) == want and any(x[1] > 10 for x in want)


def test_ranking(spark):
    cols = "name string, relative_path string, intent string, description string, triggers array<string>, action_triggers array<string>, micro_rules array<string>, keywords array<string>, content string"
    rows = [("rust-tests", "rust", "test rust", "", [], ["testing"], [], [], ""), ("sql-tuning", "db", "tune sql", "", [], ["query"], [], [], "")]
    tasks = spark.createDataFrame([(1, "sql-tuning"), (2, "nothing here")], "query_id long, text string")
    got = ranking.stage_one(spark.createDataFrame(rows, cols), tasks, 5).where("query_id = 1").orderBy("rank").collect()
    assert got[0]["name"] == "sql-tuning" and got[0]["score"] == 1.4
    kept = ranking.rerank(ranking.stage_one(spark.createDataFrame(rows, cols), tasks, 5), providers.overlap_logit)
    assert {r["name"] for r in kept.collect()} <= {"rust-tests", "sql-tuning"}


def test_search_scopes(spark):
    none = spark.createDataFrame([], "query_id long, path string, score double")
    some = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "query_id long, path string, score double")
    assert [(r["phase"], r["rank"], r["path"]) for r in search.cascade([(none, 5), (some, 1), (some, 5)]).collect()] == [(2, 1, "b")]
    with pytest.raises(ValueError, match="unknown scope"):
        search.navigate({"content": some}, scope="files")


def test_files(spark, tmp_path):
    for name in ("src/a.rs", "target/b.rs", ".hidden/c", "src/deep/d.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    walked = tree.walk(spark, str(tmp_path)).collect()
    assert [(r["path"], r["file_type"]) for r in walked] == [("src", "directory"), ("src/a.rs", "file"), ("src/deep", "directory"), ("src/deep/d.py", "file")]
    paths = spark.createDataFrame([("src/a.rs",), ("build/x.rs",), ("a.min.js",), ("builder/x.rs",)], "path string")
    assert [r["path"] for r in paths.where(files.relevant(F.col("path"))).collect()] == ["src/a.rs", "builder/x.rs"]
    listed = [("s/one/SKILL.md", "name: First"), ("s/one/sub/SKILL.md", "inner"), ("s/cheatsheets/git_tips.md", "x"), ("s/docs/SKILL.md", "y"), ("s/cheatsheets/README.md", "z")]
    own = files.skills(spark.createDataFrame(listed, "path string, content string"))
    assert sorted(r["name"] for r in own.collect()) == ["first", "git-tips"]
    assert files.catalog([("embedded", own), ("local", own)]).where("source = 'embedded'").count() == 2
    assert files.find_skill(own, "s/one").count() == 1


def test_requested_skills(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c.md",), ("d",), ("a",)], "name string")
    proposals, embedded = spark.createDataFrame([("a", "from a proposal")], "name string, content string"), spark.createDataFrame([("a", "x"), ("b", "embedded")], "name string, content string")
    local = spark.createDataFrame([("c.md", "local"), ("b", "y")], "path string, content string")
    got = {r["name"]: (r["origin"], r["content"]) for r in files.requested(names, proposals, embedded, local).collect()}
    assert got == {"a": ("proposal", "from a proposal"), "b": ("catalog", "embedded"), "c.md": ("file", "local"), "d": (None, None)}


def test_session_store(spark, tmp_path):
    schema = "session_id string, stage string"
    for i, (name, text) in enumerate((("s1", '{"session_id": "s1", "stage": "Plan"}'), ("s2", '{"session_id": "s2", "stage": "Fix"}'), ("bad", "{not json"))):
        (tmp_path / "sessions").mkdir(exist_ok=True)
        path = tmp_path / "sessions" / f"{name}.json"
        path.write_text(text)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    folder = str(tmp_path / "sessions")
    assert [r["session_id"] for r in files.sessions(spark, folder, schema).collect()] == ["s2", "s1"]
    assert files.session_by_id(spark, folder, "s1", schema).first()["stage"] == "Plan"
    with pytest.raises(KeyError):
        files.session_by_id(spark, folder, "s9", schema)
    for name in ("../sessions/s1", "/s1", "", "a//s1", "..", "x\\..\\s1"):
        with pytest.raises(ValueError, match="names no session"):
            files.session_by_id(spark, folder, name, schema)
    with pytest.raises(ValueError, match="corrupted"):
        files.session_by_id(spark, folder, "bad", schema)
    assert files.newest_session(spark, folder, schema).first()["session_id"] == "s2"
    (tmp_path / "none").mkdir()
    (tmp_path / "session.json").write_text('{"session_id": "old", "stage": "Build"}')
    assert files.newest_session(spark, str(tmp_path / "none"), schema, str(tmp_path / "session.json")).first()["session_id"] == "old"


def test_snapshot_cache(spark):
    made, stamp, now = [], [1], [0.0]
    own = files.Snapshot(lambda: made.append(1) or {"files": spark.range(3)}, lambda: stamp[0], clock=lambda: now[0])
    assert own.tables()["files"].count() == 3 and own.tables() is own.tables() and len(made) == 1
    stamp[0] = 2
    own.tables()
    now[0] = 2.5
    own.tables()
    assert len(made) == 3
    own.invalidate()
    assert own.held is None


def test_bounded_read(spark):
    long = "fn big() {\n" + "\n".join(f"  let x{i} = {i};" for i in range(400)) + "\n}\n"
    rows = [("a.rs", long), ("b.rs", "fn small() {\n  1\n}\n\n\n\nfn other() {}\n"), ("c.md", "![x](https://img.shields.io/y)\ntext  \n")]
    df = spark.createDataFrame(rows, "path string, content string")
    auto = {r["path"]: r for r in code.bounded_read(df).collect()}
    assert "big() { /* L1-402: 402 lines */ }" in auto["a.rs"]["view"] and not auto["a.rs"]["capped"]
    assert auto["b.rs"]["view"] == "fn small() {\n  1\n}\n\nfn other() {}" and auto["c.md"]["view"] == "\ntext"
    full = {r["path"]: r for r in code.bounded_read(df, mode="full").collect()}
    assert full["a.rs"]["capped"] and full["a.rs"]["n_lines"] == 402 and full["a.rs"]["view"].count("\n") == 299
    own = {r["path"]: r for r in code.bounded_read(df, "small").collect()}
    assert own["b.rs"]["view"] == "fn small() {\n  1\n}" and own["a.rs"]["view"].count("\n") == 299
    assert "Structural Skeleton" in code.bounded_read(df.where("path = 'a.rs'"), mode="skeleton").first()["view"]
    assert code.listing(df).where("path = 'b.rs'").orderBy("line_no").first()["entry"] == "L0001: fn small() {"


def test_phase_and_language_rules(spark):
    rules = spark.createDataFrame([("plan", "keep it simple"), ("core", "think")], "group string, rule string")
    phases = spark.createDataFrame([(" Design ",), ("anything",), ("read",)], "phase string")
    assert {r["phase"]: (r["group"], r["rule"]) for r in documents.phase_rules(phases, rules).collect()} == {" Design ": ("plan", "keep it simple"), "anything": ("core", "think"), "read": ("explore", None)}
    profile = documents.language_profile(spark.createDataFrame([("a.hpp",), ("Dockerfile",)], "path string"), "")
    assert profile.first()["primary_languages"] == ["c", "c++"] and profile.first()["secondary_tech"] == ["devops", "docker"]
    mine = spark.createDataFrame([("docker", "pin images"), ("rust", "x")], "language string, rule string")
    assert [r["rule"] for r in documents.language_rules(profile, mine).collect()] == ["pin images"]


def test_places_of_a_whole_table(spark):
    rng = random.Random(9)
    values = [(i, rng.choice([None, rng.randint(0, 50)])) for i in range(3000)]
    own = usage.sorted_rows(spark.createDataFrame(values, "id long, n long").repartition(7), "n", "id", descending=True)
    want = sorted(values, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [(r["id"], r["n"]) for r in own.orderBy("place").collect()] == want and own.agg(F.max("place")).first()[0] == 3000
    assert "SinglePartition" not in own._jdf.queryExecution().executedPlan().toString()


def test_sorted_rows_and_catalog_hash(spark):
    df = spark.createDataFrame([(1, "b", 10.0), (2, "A", None), (3, "c", 9.0)], "id int, name string, n double")
    assert [r["id"] for r in usage.sorted_rows(df, "name", "id").orderBy("place").collect()] == [2, 1, 3]
    assert [r["id"] for r in usage.sorted_rows(df, "n", "id", descending=True).orderBy("place").collect()] == [1, 3, 2]
    from quarrylight.functions.text import catalog_hash

    def mark(rows):
        return rows.agg(catalog_hash(F.col("id"), F.col("name")).alias("h")).first()["h"]

    assert mark(df) == mark(df.repartition(3)) != mark(df.withColumn("id", 4 - F.col("id")))


def test_vectors(spark, tmp_path):
    import numpy as np

    a = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "v.bin").write_bytes(files.encode_vectors(a))
    got = files.read_vectors(spark, str(tmp_path / "v.bin")).orderBy("ord").collect()
    assert [r["vector"] for r in got] == a.tolist()
    with pytest.raises(ValueError, match="bytes"):
        files.decode_vectors(b"\x01\0\0\0\x02\0\0\0\0")


def test_late_rows_and_state(spark, tmp_path):
    """Rows within the watermark change their window again; later ones are dropped, from the batch after next on, as Spark has it."""
    schema, folder = "ts timestamp, tokens long", tmp_path / "in"
    at = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    batches = [[(at(0, 5), 1), (at(1, 5), 1)], [(at(30), 10)], [(at(29, 30), 100)], [(at(0, 10), 1000)], [(at(60), 1)], [(at(61), 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
    for i in range(len(batches)):  # the stream takes files by their times
        for f in (folder / f"b{i}").glob("part-*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = streaming.read_events(spark, str(folder / "*"), schema)
    root = str(tmp_path / "state")
    got = {r["start"]: (r["calls"], r["tokens"]) for r in streaming.drain(streaming.hourly(stream), ["start"], root).collect()}
    assert got == {at(0): (1, 1), at(1): (1, 1), at(29): (1, 100), at(30): (1, 10), at(60): (1, 1), at(61): (1, 1)}
    again = streaming.drain(streaming.hourly(stream), ["start"], root)  # nothing is new
    assert {r["start"]: (r["calls"], r["tokens"]) for r in again.collect()} == got and again.columns == ["start", "calls", "tokens"]


def test_backlog(spark):
    units = spark.createDataFrame([(i, f"text {i}") for i in range(230)], "id long, body string")
    done = spark.createDataFrame([(i, [0.0]) for i in range(0, 230, 2)], "id long, vector array<float>")
    new = providers.embed_backlog(units, done, "id", F.col("body"))
    assert {r["id"] for r in new.collect()} == set(range(1, 230, 2)) and new.where("size(vector) = 0 OR vector IS NULL").count() == 0
    assert providers.embed_backlog(units, done.select("id").unionByName(new.select("id")), "id", F.col("body")).count() == 0


def test_sessions_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = streaming.read_events(spark, sf_dir, schema, pattern="events.parquet").withColumn("tokens", F.lit(1))
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start")).count()
    got = streaming.drain(streaming.hourly(events), ["start"])
    assert {(r["start"], r["calls"]) for r in got.collect()} == {(r["start"], r["count"]) for r in batch.collect()}
