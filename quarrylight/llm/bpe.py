"""Byte-level BPE by a global shuffle of distinct words.

Texts are dealt into blocks of bounded size. A block explodes into pre-tokens with
positions: its distinct pre-tokens (words) are numbered, and each text is the sequence
of their numbers. Distinct words go to the bucket of their hash, where all blocks'
copies of a word meet in one task that encodes it once and sends identifiers back under
the block's number. They are joined with the block's positions, which put the identifiers
of each text in order. Decoding joins the identifiers with the token-byte table, whose
size is that of the vocabulary.

A block sends a word once however often it occurs, so a frequent word costs one entry
for a block and no task is larger for it. Texts are not shuffled, only positions.

Words and positions leave in two passes over the input, so that neither has to be
stored. Should the passes see rows in another order, the checksum of a bucket's words
tells, and the block encodes those words itself; the result is the same.

Defined cases: null text is empty and has no tokens; repeated rows and identifiers,
null ones included, are rows of their own; extra columns are kept out; a text longer
than a block is a block of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK, Pieces, Ragged, blocks
from .common import documents, hash_buckets, lean, lean_group, pack, splits, unpack
from .tokenizers_io import BYTE_RANKS, pretokens, rank_coder, token_bytes, vocabulary

_MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.binary())])
_MESSAGE_DDL = "block long, bucket int, body binary"
_WORDS, _PLACES = 0, 1


class Block:
    """words: the distinct pre-tokens of some texts, by falling frequency; places: the words of each text, in order."""

    def __init__(self, texts: list[bytes]):
        pieces, find = Pieces(texts), pretokens().findall
        number: dict[str, int] = {}
        parts = [[number.setdefault(w, len(number)) for w in find(p.decode("utf-8", "surrogatepass"))] for p in pieces.values.to_pylist()]
        of = Ragged.of(parts, np.int32)
        places = of.take(pieces.index)
        order = np.argsort(-np.bincount(places.flat, minlength=len(number)), kind="stable")
        rank = np.empty(len(number), np.int32)
        rank[order] = np.arange(len(number))
        words = list(number)
        self.words = [words[i].encode("utf-8", "surrogatepass") for i in order.tolist()]
        sums, first = np.r_[0, np.cumsum(places.lengths)], np.r_[0, np.cumsum(pieces.counts)]
        self.places = Ragged(rank[places.flat], sums[first[1:]] - sums[first[:-1]])

    def dealt(self, buckets: int) -> list[tuple[int, list[bytes], np.ndarray]]:
        """For each bucket that has any: it, its words and their numbers."""
        key = np.fromiter(map(zlib.crc32, self.words), np.int64, len(self.words)) % buckets
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True]) if len(order) else [0]
        return [(int(key[order[a]]), [self.words[i] for i in order[a:z].tolist()], order[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch, Block]]:
    number = 0
    for b, texts in blocks(batches, size):
        yield b.column("part")[0].as_py() << 32 | number, b, Block(texts)
        number += 1


def _messages(blocks_of: list[int], buckets: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks_of, pa.int64()), pa.array(buckets, pa.int32()), pa.array(bodies, pa.binary())], schema=_MESSAGE)


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, words), "<u4", len(words)), np.frombuffer(b"".join(words), np.uint8)


def _parted(lengths: np.ndarray, raw: np.ndarray) -> list[bytes]:
    flat, ends = raw.tobytes(), np.cumsum(lengths.astype(np.int64))
    return [flat[a:z] for a, z in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def _send_words(buckets: int, size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, own in _numbered(batches, size):
            dealt = own.dealt(buckets)
            yield _messages([block] * len(dealt), [k for k, _, _ in dealt], [pack(*_joined(words)) for _, words, _ in dealt])

    return make


def _planes(x: np.ndarray) -> list[np.ndarray]:
    """Bytes of the same weight beside each other, which compress better."""
    return [np.ascontiguousarray(x.astype("<u4").view(np.uint8)[k::4]) for k in range(4)]


def _unplaned(planes: list[np.ndarray]) -> np.ndarray:
    return np.column_stack(planes).ravel().view("<u4").astype(np.int64)


def _send_places(buckets: int, size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b, own in _numbered(batches, size):
            null = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            docs = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            head = (null.astype(np.uint8), docs, own.places.lengths.astype("<u4"))
            yield _messages([block], [-1], [pack(*head, *_planes(own.places.flat), *_joined(own.words))])

    return make


def _encoded(words: list[bytes], path: str) -> Ragged:
    """Identifiers of words, each encoded on its own."""
    return rank_coder(path).make([w.decode("utf-8", "surrogatepass") for w in words])


def _encode_words(path: str):
    def encode(key: tuple, table: pa.Table) -> pa.Table:
        """Each distinct word of the bucket once; every block's words with the checksum of their list."""
        bodies = table.column("body").to_pylist()
        lists, number = [], {}
        for body in bodies:
            words = _parted(*unpack(body))
            lists.append((zlib.crc32(b"\0".join(words)), np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))))
        ids, out = _encoded(list(number), path), []
        for check, own in lists:
            got = ids.take(own)
            out.append(pack(np.array([check], "<u4"), got.lengths.astype("<u4"), got.flat.astype("<u4")))
        return pa.table([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], schema=_MESSAGE)

    return encode


_CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def _reassemble(path: str, buckets: int):
    def reassemble(key: tuple, table: pa.Table) -> pa.Table:
        bodies = dict(zip(table.column("bucket").to_pylist(), table.column("body").to_pylist(), strict=True))
        if -1 not in bodies:
            return _CODED.empty_table()
        null, docs, lengths, *planes, sizes, raw = unpack(bodies.pop(-1))
        own = Block.__new__(Block)
        own.words = _parted(sizes, raw)
        found, where, before = [], np.empty(len(own.words), np.int64), 0
        for k, words, numbers in own.dealt(buckets):
            check, n, ids = unpack(bodies[k]) if k in bodies else (np.zeros(0, "<u4"),) * 3
            got = Ragged(ids, n) if len(n) == len(words) and check[0] == zlib.crc32(b"\0".join(words)) else _encoded(words, path)
            found.append(got)
            where[numbers] = np.arange(len(words)) + before
            before += len(words)
        of = Ragged(np.concatenate([np.zeros(0, "<u4"), *(x.flat for x in found)]), np.concatenate([np.zeros(0, np.int64), *(x.lengths for x in found)])).take(where)
        lengths = lengths.astype(np.int64)
        coded = of.take(_unplaned(planes))
        sums, first = np.r_[0, np.cumsum(coded.lengths)], np.r_[0, np.cumsum(lengths)]
        flat, ends = coded.flat.astype("<u4").tobytes(), 4 * sums[first]
        ids = pa.array([flat[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
        return pa.table([pa.array(docs, mask=null.astype(bool)), ids], schema=_CODED)

    return reassemble


def encode(docs: DataFrame, *, ranks: str | None = None, block_bytes: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """doc_id and ids, the identifiers as little-endian unsigned 32-bit integers."""
    path = ranks or vocabulary(BYTE_RANKS)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    count = buckets or hash_buckets(splits(source))
    words = source.mapInArrow(lean(_send_words(count, block_bytes)), _MESSAGE_DDL).groupBy("bucket").applyInArrow(lean_group(_encode_words(path)), _MESSAGE_DDL)
    places = source.mapInArrow(lean(_send_places(count, block_bytes)), _MESSAGE_DDL)
    return words.unionByName(places).groupBy("block").applyInArrow(lean_group(_reassemble(path, count)), "doc_id long, ids binary")


def _decode(path: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in batches:
            texts = [table.take(np.frombuffer(x, "<u4")).flat.tobytes() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*b.schema.names, "decoded"])

    return make


def decode(coded: DataFrame, *, ranks: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: the bytes that the identifiers stand for, by the token-byte table."""
    return coded.select("doc_id", "ids").mapInArrow(lean(_decode(ranks or vocabulary(BYTE_RANKS))), "doc_id long, ids binary, decoded binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(documents(spark, sf_dir)))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
