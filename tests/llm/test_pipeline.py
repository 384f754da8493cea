"""The pipeline's stages on a small table, against plain versions, and its SQL-checked operators."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from quarrylight.llm import pipeline_stages as P
from quarrylight.llm import registry
from quarrylight.llm.common import Scratch, documents

from .test_operators import components, shingle_set


def test_stages_in_order(spark, sf_dir):
    scratch, docs = Scratch(spark, "test"), documents(spark, sf_dir)
    before = {r["doc_id"]: r for r in docs.collect()}
    toxic = {r["doc_id"] for r in registry.QUERIES["op7_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    for name, stage in P.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        assert docs.columns == P.COLUMNS
        own = {r["doc_id"]: r for r in docs.collect()}
        if name == "toxicity":
            assert set(own) == set(before) - toxic and all(own[i] == before[i] for i in own)
        elif name == "line_dedup":
            assert set(own) == set(before) and all(r["n_chars"] == len(r["text"]) for r in own.values())
        elif name == "ngram_jaccard_join":
            want = components({i: shingle_set(r["text"]) for i, r in before.items()})
            assert set(own) == set(want.values()) and all(own[i] == before[i] for i in own)
        else:
            assert set(own) == set(before) and all((r["lang"], r["source"]) == (before[i]["lang"], before[i]["source"]) for i, r in own.items())
            assert all(len(r["text"]) <= len(before[i]["text"]) for i, r in own.items())
        before = own
    pieces = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == set(before)


def test_stages_on_awkward_rows(spark, sf_dir, tmp_path):
    """Null and repeated identifiers, null, empty and very long texts, repeated rows, other columns; then no rows at all."""
    words = " ".join(f"word{i} und{i % 13}" for i in range(90))
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, words), (3, words), (3, "another text of the same identifier"), (4, words + " end"), (None, words + " x"), (None, "a line of its own\nhere"), (None, None), (5, long), (6, long), (7, "a line of its own\nthere")]
    made = [(i, t, "en", "s", None if t is None else len(t), 1.5, "y") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, node double, kept_text string"
    want = {
        "toxicity": [t or "" for _, t in rows],
        "line_dedup": ["", "", words, words, "another text of the same identifier", words + " end", words + " x", "here", "", long, "", "a line of its own\nthere"],
        "ngram_jaccard_join": ["", "", "", words, "another text of the same identifier", "a line of its own\nhere", "a line of its own\nthere", long],
    }
    docs = spark.createDataFrame(made, schema)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir).collect()
        texts = sorted((r["text"] or "") for r in out) if "text" in out[0] else None
        if name in want:
            assert texts == sorted(want[name]), name
        elif name == "suffix_array_dedup":
            assert len(out) == len(rows) and sum(r["text"] == "" for r in out) >= 5  # copies remove each other
        else:
            assert {r["doc_id"] for r in out} == {i for i, _ in rows} and sum(r["piece"] == 0 for r in out) == len(rows)
        assert stage(spark, spark.createDataFrame([], schema), sf_dir).count() == 0


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    before = len(Scratch.made_so_far)
    out = corpus_pipeline.run(spark, sf_dir)
    assert len(Scratch.made_so_far) == before + 1  # only the stages' own results are left
    assert out.count() > 0 and "sequence_id" in out.columns


def test_oracles(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    for name, sql in registry.SQL.items():
        ours, theirs = registry.QUERIES[name](spark, sf_dir).toPandas(), con.execute(sql).df()
        columns = sorted(theirs.columns)
        assert sorted(map(str, ours[columns].values.tolist())) == sorted(map(str, theirs[columns].values.tolist()))
        assert len(hashlib.sha256().hexdigest()) == 64
