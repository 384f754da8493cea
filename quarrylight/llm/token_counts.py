"""Edit-aware token counts: a stored segment tree over the text of each document.

The leaves of a tree are stretches of the text of about ``leaf`` bytes, cut where white
space follows a visible character, as no pre-token crosses such a place; every inner
node holds the characters and the tokens below it. ``build_trees`` encodes each text
once and returns its tree as a value that can be stored. ``apply_edits`` takes stored
trees and returns the trees after the edits, and takes those again for later edits: an
edit finds its leaves by descending the character sums, re-encodes only the region they
form, and updates the sums on the paths to the root.

Whether a cut stays valid depends on the two characters beside it alone. The region of an
edit therefore takes in one leaf more on the left while its first character is not white
space, and one more on the right while its last is white space: boundary context beyond
which nothing can have changed.

Defined cases: null text is empty; edits beyond the end of a text are moved to its end;
a negative start is 0; null edits, and nulls inside them, mean nothing to remove or
insert; edits of a document apply one after the other, each to the text that the one
before left; a column ``edits`` of another kind and other extra columns are ignored;
repeated rows and null identifiers are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import _UNICODE_SPACE, blocks
from .common import Scratch, documents, lean, pack, unpack
from .tokenizers_io import BYTE_RANKS, rank_coder, rank_encoding, vocabulary

LEAF = 256


def _blank(char: str) -> bool:
    """Whether a character is white space, for sure."""
    return char in "\t\n\x0b\x0c\r " or bool(_UNICODE_SPACE.fullmatch(char.encode("utf-8", "surrogatepass")))


def _visible(char: str) -> bool:
    return char > " " and char != "\x7f" and not _blank(char)


class SegmentTree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.leaves = list(leaves)
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(leaves), 0] = [len(p) for p in leaves]
        self.sums[self.width : self.width + len(leaves), 1] = tokens
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @staticmethod
    def load(body: bytes) -> SegmentTree:
        chars, tokens, raw = unpack(body)
        text, ends = raw.tobytes().decode("utf-8", "surrogatepass"), np.cumsum(chars.astype(np.int64))
        return SegmentTree([text[a:z] for a, z in zip((ends - chars).tolist(), ends.tolist(), strict=True)], tokens.tolist())

    def store(self) -> bytes:
        own = [i for i, leaf in enumerate(self.leaves) if leaf]
        return stored([len(self.leaves[i]) for i in own], [int(self.sums[self.width + i, 1]) for i in own], self.text().encode("utf-8", "surrogatepass"))

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one, if it is the end), and the place of its first character."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            left = int(self.sums[node, 0])
            if at - before >= left and self.sums[node + 1, 0]:
                before, node = before + left, node + 1
        return node - self.width, before

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.width
        self.sums[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, length: int, insert: str, encode) -> int:
        """Replaces ``length`` characters at ``start``; returns how many characters were encoded again."""
        start = min(max(start, 0), self.chars)
        end = min(start + max(length, 0), self.chars)
        if not self.leaves:
            self.leaves = [""]
        first, before = self.find(start)
        last, at = self.find(end)
        after = at + len(self.leaves[last])
        region = "".join(self.leaves[first : last + 1])
        region = region[: start - before] + insert + region[end - before :]
        while before and not (region and _blank(region[0])):  # the leaf on the left ends visibly, so white space here begins a match
            own, before = self.find(before - 1)
            region, first = self.leaves[own] + region, own
        while after < self.chars and not (region and _visible(region[-1])):
            last, at = self.find(after)
            region, after = region + self.leaves[last], at + len(self.leaves[last])
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self.put(leaf, "", 0)
        self.put(first, region, len(encode(region)))
        return len(region)


def stored(chars, tokens, raw: bytes) -> bytes:
    return pack(np.asarray(chars, np.uint32), np.asarray(tokens, np.uint32), np.frombuffer(raw, np.uint8))


class Builder:
    """Makes stored trees of blocks of texts."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.coder, self.leaf = rank_coder(path), leaf

    def trees(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The tree of each text, and its tokens."""
        pieces = self.coder.learn(texts)
        n = self.coder.of.lengths[pieces.index]
        first = np.cumsum(pieces.counts) - pieces.counts
        sums, edges = np.r_[0, np.cumsum(n)], pieces.offsets
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin, full = np.cumsum(size) - size, pieces.counts > 0
        # a leaf begins at the first break in each stretch of ``leaf`` bytes
        at = np.flatnonzero(pieces.breaks)
        own = np.searchsorted(first[full], at, side="right") - 1
        stretch = (edges[at] - begin[full][own]) // self.leaf
        at = at[np.r_[True, (np.diff(stretch) != 0) | (np.diff(own) != 0)][: len(at)]]
        of_text, ends = np.searchsorted(at, np.r_[first, len(n)]), np.r_[at[1:], len(n)][: len(at)]
        leaf_chars = np.add.reduceat((pieces.data & 0xC0) != 0x80, edges[at], dtype=np.int64) if len(at) else at
        leaf_tokens = sums[ends] - sums[at]
        made = [stored(leaf_chars[a:z], leaf_tokens[a:z], t) for a, z, t in zip(of_text[:-1].tolist(), of_text[1:].tolist(), texts, strict=True)]
        return made, sums[first + pieces.counts] - sums[first]


def build_trees(docs: DataFrame, *, ranks: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The columns of ``docs`` without text, then tree."""
    path, rest = ranks or vocabulary(BYTE_RANKS), [c for c in docs.columns if c not in ("text", "tree")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Builder(path, leaf)
        for b, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(builder.trees(texts)[0], pa.binary())], names=[*rest, "tree"])

    kinds = dict(docs.dtypes)
    return docs.select(*rest, "text").mapInArrow(lean(make), ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "tree binary"]))


_EDITS = "array<struct<start:long,length:long,insert:string>>"


def _edit(path: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoding(path).encode_ordinary
        for b in batches:
            trees, before, after, again, chars = [], [], [], [], []
            for body, edits in zip(b.column("tree").to_pylist(), b.column("edits").to_pylist(), strict=True):
                tree = SegmentTree.load(body)
                before.append(tree.tokens)
                again.append(sum(tree.edit(e["start"] or 0, e["length"] or 0, e["insert"] or "", encode) for e in edits or () if e))
                after.append(tree.tokens)
                chars.append(tree.chars)
                trees.append(tree.store() if edits else body)
            out = [b.column("doc_id"), pa.array(trees, pa.binary()), *(pa.array(x, pa.int64()) for x in (before, after, chars, again))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "tree", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"])

    return make


def apply_edits(trees: DataFrame, *, ranks: str | None = None) -> DataFrame:
    """doc_id, tree (after the edits), n_tokens (before), n_tokens_edited, n_chars_edited, n_chars_encoded.

    trees: doc_id, tree and edits, an array of (start, length, insert) in characters.
    """
    source = trees.select("doc_id", "tree", trees["edits"].cast(_EDITS).alias("edits"))
    return source.mapInArrow(lean(_edit(ranks or vocabulary(BYTE_RANKS))), "doc_id long, tree binary, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long")


def _is_edits(docs: DataFrame) -> bool:
    kind = dict(docs.dtypes).get("edits", "")
    return kind.startswith("array<struct<") and all(f"{n}:" in kind for n in ("start", "length", "insert"))


def token_counts(docs: DataFrame, *, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and after the edits n_tokens_edited, n_chars_edited, n_chars_encoded.

    docs: doc_id, text and, optionally, edits, an array of (start, length, insert) in
    characters. Trees are built and stored in the shared folder, and the edits applied to
    the stored trees.
    """
    scratch = Scratch(docs.sparkSession, "trees")
    edits = docs["edits"].cast(_EDITS) if _is_edits(docs) else F.lit(None).cast(_EDITS)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", edits.alias("edits"))
    return apply_edits(scratch.keep(build_trees(source, ranks=ranks), "trees"), ranks=ranks).drop("tree")


def planned_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document: a heading, a replacement in the middle, a signature at the end."""
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")

    def edit(start, length: int, insert):
        return F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))

    source = F.coalesce("source", F.lit("unknown"))
    return docs.withColumn("edits", F.array(edit(F.lit(0), 0, F.concat(source, F.lit("\n"))), edit(F.floor(size / 2), 12, F.lit(" was revised")), edit(size + 1000, 0, F.concat(F.lit("\n-- "), source))))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(planned_edits(documents(spark, sf_dir).select("doc_id", "text", "source")))
