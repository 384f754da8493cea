"""Line deduplication: explode normalised lines, hash, count documents, drop, reassemble.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at either end
and with A-Z lower-cased. Keys of at least ``min_chars`` code points that occur in
at least ``min_docs`` documents lose all their lines except in the document with
the smallest identifier. Keys travel as 16-byte digests, once for a document; the
counts are partial aggregates before they are shuffled, and only what a document
has to drop returns to it.

Defined cases: null or empty text is one empty line; rows that share an
identifier are one document when documents are counted, and each is rebuilt from
its own text; rows without an identifier count as one document together, after all
others; a text that loses all lines is empty; an empty table gives an empty result;
extra columns stay, but for those named kept_text, n_lines or n_dropped, which the
results replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column_bytes, documents, lean

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_LAST = 2**63 - 1


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _explode(min_chars: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owners, keys = [], []
            for doc, text in zip(b.column("doc").to_pylist(), column_bytes(b, "text"), strict=True):
                found = {_digest(k) for k in map(line_key, text.split(b"\n")) if _long(k, min_chars)}
                keys += found
                owners += [doc] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(keys, pa.binary())], names=["doc", "key"])

    return make


def _rebuild(min_chars: int, columns: list[str]):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, dropped = [], [], []
            for text, drop in zip(column_bytes(b, "text"), b.column("drops").to_pylist(), strict=True):
                all_lines = text.split(b"\n")
                lines.append(len(all_lines))
                if drop:
                    gone = set(drop)
                    stay = [x for x in all_lines if not (_long(k := line_key(x), min_chars) and _digest(k) in gone)]
                    dropped.append(len(all_lines) - len(stay))
                    text = b"\n".join(stay)
                else:
                    dropped.append(0)
                texts.append(text)
            kept = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), kept, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*columns, "kept_text", "n_lines", "n_dropped"])

    return make


def line_dedup(docs: DataFrame, *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The columns of ``docs`` without text, then kept_text, n_lines, n_dropped."""
    scratch = Scratch(docs.sparkSession, "lines")
    doc = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("doc")
    lines = scratch.keep(docs.select(doc, "text").mapInArrow(lean(_explode(min_chars)), "doc long, key binary"), "keys")
    counts = lines.groupBy("key").agg(F.count_distinct("doc").alias("n"), F.min("doc").alias("first"))
    # written, so that a key with very many lines meets it in a plain join of two exchanges, which Spark can split
    common = scratch.keep(counts.where(F.col("n") >= min_docs).select("key", "first"), "common")
    drops = lines.join(common, "key").where("doc != first").groupBy("doc").agg(F.collect_set("key").alias("drops"))
    rest = [c for c in docs.columns if c not in ("text", "kept_text", "n_lines", "n_dropped")]
    inner = docs.select(F.struct(*rest).alias("_rest"), "text", doc.alias("_doc"))
    joined = inner.join(drops.withColumnRenamed("doc", "_doc"), "_doc", "left").select("_rest", "text", "drops")
    kind = joined.schema["_rest"].dataType.simpleString()
    built = joined.mapInArrow(lean(_rebuild(min_chars, ["_rest"])), f"_rest {kind}, kept_text string, n_lines long, n_dropped long")
    return built.select("_rest.*", "kept_text", "n_lines", "n_dropped")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op5_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT doc_id, line, pos,
                   translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines
        ), common AS (
            SELECT key, min(doc_id) AS first FROM keyed
            WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
            SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AND k.doc_id <> c.first AS gone
            FROM keyed k LEFT JOIN common c ON k.key = c.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """
}
