"""Every query that has SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from quarrylight.plans import catalog


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        try:
            return round(float(v), 5)
        except (TypeError, ValueError):
            return str(v)

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_queries_find_something(spark, sf_dir, duck):
    """The full-text, alias and edge phases have rows to compare."""
    phases = {r["phase"] for r in catalog.QUERIES["cascade_batch"](spark, sf_dir).collect()}
    sections = {r["section"] for r in catalog.QUERIES["navigate_batch"](spark, sf_dir).collect()}
    assert {1, 5} <= phases and {"aliases", "content", "edges"} <= sections


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_others_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "phase", "rank", "path", "score"]
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
