"""Line windows, full-text index and search over a document table (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, content_hash, lines_of, tokens_of, trimmed

SIZE, OVERLAP, LEAST = 50, 10, 3


def chunk_windows(docs: DataFrame, *, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """doc_id, start_line, end_line, n_filled, chunk_text: windows of ``size`` lines with at least ``least`` that are not blank."""
    step = size - overlap
    lines = docs.select("doc_id", lines_of(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(step))
    cut = F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice("lines", at + 1, F.lit(size)).alias("own")))
    own = lines.select("doc_id", F.inline(cut))  # slices leave the row, not copies of all of its lines
    filled = F.size(F.filter("own", lambda x: trimmed(x) != ""))
    return own.where(filled >= least).select(
        "doc_id",
        (F.col("at") + 1).alias("start_line"),
        (F.col("at") + F.size("own")).alias("end_line"),
        filled.alias("n_filled"),
        F.array_join("own", "\n").alias("chunk_text"),
    )


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Chunks with a stable identifier and a hash of their text."""
    chunks = chunk_windows(docs)
    return chunks.withColumn("id", F.xxhash64("doc_id", "start_line")).withColumn("content_hash", content_hash(F.col("chunk_text")))


def postings(units: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Inverted index: term and keys, once for each unit that holds the term."""
    return units.select(*keys, F.explode(F.array_distinct(tokens_of(text))).alias("term"))


def positions(units: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Inverted index with places, for phrases and snippets."""
    return units.select(*keys, F.posexplode(tokens_of(text)).alias("pos", "term"))


def match_all(index: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of query_id and unit that hold all terms of the query.

    terms: query_id, term. Queries without terms match nothing. One pass over the postings
    gathers for each unit those of its terms that any query has, and apart those that are the
    longest of a query; a unit meets only the queries whose longest term it holds, so that a
    term which many queries share, mostly a short one, multiplies nothing.
    """
    order = F.struct(F.length("term").alias("n"), "term")
    asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("wanted"), F.max(order)["term"].alias("anchor"))
    marks = terms.select("term").distinct().join(asked.select(F.col("anchor").alias("term"), F.lit(True).alias("anchors")).distinct(), "term", "left")
    used = index.join(marks, "term")
    units = used.groupBy(*keys).agg(F.collect_set("term").alias("held"), F.collect_set(F.when(F.col("anchors"), F.col("term"))).alias("anchors"))  # as many as a unit has words
    met = units.select(*keys, "held", F.explode("anchors").alias("anchor")).join(asked, "anchor")
    return met.where(F.size(F.array_except("wanted", "held")) == 0).select("query_id", *keys)


def query_terms(queries: DataFrame, text: Column) -> DataFrame:
    """query_id and the distinct terms of a text."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens_of(text))).alias("term"))


def snippet(text: Column, terms: Column, around: int = 7) -> Column:
    """Tokens about the first that matches, that one between marks."""
    tokens = tokens_of(text)
    at = F.array_position(F.transform(tokens, lambda t: F.array_contains(terms, t)), True).cast("int")
    begin = F.greatest(at - around, F.lit(1))
    own = F.concat(F.slice(tokens, begin, at - begin), F.array(F.concat(F.lit("»"), F.element_at(tokens, at), F.lit("«"))), F.slice(tokens, at + 1, F.lit(around)))
    return F.when(at > 0, F.array_join(own, " "))


def line_references(docs: DataFrame, needle: str, *, limit: int = 30, width: int = 100) -> DataFrame:
    """Lines that contain ``needle`` in any case, in order, clipped to ``width`` characters."""
    lines = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    found = lines.where(F.contains(F.lower("line"), F.lit(needle.lower())))
    return found.select("doc_id", (F.col("at") + 1).alias("line_no"), clip(trimmed("line"), width).alias("snippet")).orderBy("doc_id", "line_no").limit(limit)
