"""Scalar functions and chunks on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions.vectors import cosine
from quarrylight.operators import chunks


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_lines(spark):
    assert one(spark, "a\r\nb\n", T.lines_of) == ["a", "b"]
    assert one(spark, "", T.lines_of) == []
    assert one(spark, None, T.lines_of) == []
    assert one(spark, "a\n\n", T.lines_of) == ["a", ""]


def test_queries(spark):
    assert one(spark, 'find AND "me*" near it_now', T.sanitize_query) == '"find" "me" "it_now"'
    assert one(spark, "and or", T.sanitize_query) == ""


def test_compress(spark):
    assert one(spark, "a  \n\n\n<!-- x\ny -->\n\nb", T.compress) == "a\n\nb"
    assert one(spark, "a ![ci](https://img.shields.io/x) b\n![q](https://badge.io/y) \nz", T.compress) == "a  b\nz"


@pytest.mark.parametrize(("n", "level"), [(2, "Low"), (3, "Medium"), (8, "Medium"), (9, "High")])
def test_risk(spark, n, level):
    assert one(spark, n, T.risk_level, "int") == level


def test_shown(spark):
    assert one(spark, 3599, T.age_text, "long") == "59m ago"
    assert one(spark, 172800, T.age_text, "long") == "2d ago"
    assert one(spark, 1234, T.token_text, "long") == "1.2k"
    assert one(spark, 999, T.token_text, "long") == "999"
    assert one(spark, 86400, T.day_text, "long") == "1970-01-02"
    assert one(spark, "My Skill_x!", T.slug) == "my-skill-x"
    assert one(spark, "---\nname: 'good one'\n---", T.frontmatter_name) == "good one"
    assert one(spark, "Looks GOOD", T.is_approval) is True


@pytest.mark.parametrize(("word", "stage"), [("plan", "Plan"), (" Revise", "Ask_Revise"), ("TEST/RECHECK", "Test_Recheck"), ("review", "Proposal"), ("document", "Proposal"), ("deploy", None), (None, None)])
def test_stage(spark, word, stage):
    assert one(spark, word, T.stage_name) == stage


def test_passages_and_scales(spark):
    row = spark.createDataFrame([("function", "a.rs", None, "run", 3, 9, "x" * 600)], "k string, p string, s string, n string, a int, b int, t string").select(
        T.symbol_passage(F.col("k"), F.col("p"), F.col("s"), F.col("n")).alias("symbol"),
        T.chunk_passage(F.col("p"), F.col("a"), F.col("b"), F.col("t")).alias("chunk"),
        T.prefixed(F.col("n"), "query").alias("query"),
        T.linear_scale(F.col("a"), F.col("b"), 16, 186).alias("y"),
        T.linear_scale(F.col("a"), F.lit(0), 16, 186).alias("flat"),
        T.slot_center(F.col("a"), F.col("b"), 38, 90).alias("x"),
        T.column_width(F.col("b"), 90).alias("w"),
        T.percent_text(F.col("a")).alias("percent"),
        T.file_uri_path(F.lit("file:///a%20b/c")).alias("path"),
    ).first()
    assert row["symbol"] == "function in a.rs — run" and row["chunk"] == "code in a.rs lines 3-9: " + "x" * 512 and row["query"] == "query: run"
    assert (row["y"], row["flat"], row["x"], row["w"], row["percent"], row["path"]) == (pytest.approx(186 - 170 / 3), 186, 38 + 30 + 5, 5.0, "3.0%", "/a b/c")


def test_expand(spark):
    row = spark.createDataFrame([("fix it", "general", "test")], "t string, f string, p string").select(T.expand_query(F.col("t"), F.col("f"), F.col("p")).alias("q")).first()
    assert row["q"] == "fix it test testing unit mock"


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    for r in df.select(cosine(F.col("a"), F.col("b")).alias("got"), "want").collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-6)


@pytest.mark.parametrize(("n", "spans"), [(0, []), (1, []), (2, []), (3, [(1, 3)]), (45, [(1, 45), (41, 45)]), (50, [(1, 50), (41, 50)]), (51, [(1, 50), (41, 51)]), (95, [(1, 50), (41, 90), (81, 95)])])
def test_chunks(spark, n, spans):
    docs = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(n)))], "doc_id long, text string")
    got = chunks.chunk_windows(docs).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in got] == spans


def test_match_and_snippet(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, "the slow fox"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(7, "quick"), (7, "fox"), (8, "fox"), (9, "absent")], "query_id long, term string")
    hits = chunks.match_all(chunks.postings(docs, ["doc_id"], F.col("text")), terms, ["doc_id"])
    assert sorted((r["query_id"], r["doc_id"]) for r in hits.collect()) == [(7, 1), (8, 1), (8, 2)]
    got = docs.select(chunks.snippet(F.col("text"), F.array(F.lit("brown")), 1).alias("s")).collect()
    assert [r["s"] for r in got] == ["quick »brown« fox", None, None]
