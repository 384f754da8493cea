"""The stages of the corpus pipeline, in order.

Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``, with ``n_chars`` counted again where a text changed.

Defined cases, for every stage: rows that share an identifier and a text are one
document, those that share only the identifier are two; a null identifier is kept as it
is; null text counts as empty, and documents without text stay; other columns than those of
``documents`` go, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, line_dedup, packing, suffix_dedup, toxicity
from .blocks import BLOCK
from .common import lean

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is 1 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity(docs.select(*COLUMNS), labels)
    return scored.where("predicted = 0").select("doc_id", "text", *(f"_rest.{c}" for c in COLUMNS[2:]))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents hold go; documents that have no text left stay, empty."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS)).withColumnRenamed("kept_text", "text")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest identifier stays, one without only if all are.

    Documents are named by a hash of identifier and text, so that neither null nor repeated
    identifiers blur which text a component holds.
    """
    named = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_name"))
    found = jaccard_join.jaccard_components(named.select(F.col("_name").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("_name"), F.col("component_id").alias("_component")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_name")
    stay = named.select("doc_id", "_name").join(found, "_name").groupBy("_component").agg(F.min(order).alias("least")).select("least._name")
    return named.join(stay, "_name", "left_semi").dropDuplicates(["_name"]).select(*COLUMNS)


def _whole_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x.decode("utf-8", "ignore") for x in b.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), b.column("rest")], names=["doc_id", "text", "rest"])


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings go, and with them parts of characters that a cut has split."""
    out = suffix_dedup.suffix_dedup(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "kept", "rest")
    texts = out.mapInArrow(lean(_whole_characters), "doc_id long, text string, rest string")
    parsed = texts.withColumn("rest", F.from_json("rest", "lang string, source string"))
    return parsed.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    return packing.pack_documents(docs, block=BLOCK // 2)  # workers of earlier stages still hold memory


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_strings),
    ("best_fit_packing", pack),
]
