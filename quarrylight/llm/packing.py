"""Best-fit packing by bin completion, a branch-and-bound over undominated fillings.

A length is an integer up to the capacity, so however many pieces there are, the
problem is a histogram with at most ``capacity`` entries. The driver solves that
histogram: it takes the largest length left, enumerates the undominated fillings
around it, and branches on them in order of waste (least waste first, as best-fit
would choose); a branch ends when its bins and the waste bound of what is left
cannot beat the best solution known, which best-fit decreasing supplies at first.
A filling is used as often as the counts allow, so the work depends on the number
of lengths, not of pieces. A solution is a list of patterns with multiplicities.

Pieces get their places without any gathering: the pass that tokenises numbers the
pieces of each length within its task, a sum over tasks turns that into a rank
among all pieces of the length, and the rank decides pattern, sequence and offset.
No task sees more than its own pieces, even if one length holds most of them.

Defined cases: null text is empty, that is one end token; only documents above the
capacity are cut, the first piece takes the remainder; repeated rows are packed
each on its own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK, blocks
from .common import Scratch, documents, lean, partition_id
from .tokenizers_io import BYTE_JSON, json_coder, vocabulary

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _encode(path: str, end: int, capacity: int, block: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = json_coder(path), partition_id(), np.zeros(capacity + 1, np.int64)
        for b, texts in blocks(batches, block):
            found = coder.ids(texts)
            ends = np.cumsum(found.lengths)
            flat, lengths = np.insert(found.flat, ends, end), found.lengths + 1
            count = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            head = (lengths - (count - 1) * capacity)[doc]  # the first piece takes the remainder
            start = np.where(piece > 0, head + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head)
            at = 4 * ((np.cumsum(lengths) - lengths)[doc] + start)
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[x:z]) for x, z in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            first = np.searchsorted(length[order], np.arange(capacity + 2))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - first[length[order]] + seen[length[order]]
            seen += np.diff(first)
            docs = b.column("doc_id").take(pa.array(doc))
            rest = (piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(doc), task, np.int32), nth)
            yield pa.RecordBatch.from_arrays([docs, *map(pa.array, rest)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return make


class BinCompletion:
    """Packs a histogram {length: count} into bins; ``solve`` returns [(filling, times)].

    nodes: limit of descents, each to a complete solution or to where a bound ends it.
    width: fillings tried at a node. After ``solve``, ``ends`` counts descents, ``leaves``
    complete solutions and ``better`` those that became the best known.
    """

    def __init__(self, counts: dict[int, int], capacity: int, nodes: int = 600, width: int = 24):
        self.start = {s: n for s, n in counts.items() if n > 0}
        self.capacity, self.nodes, self.width = capacity, nodes, width
        self.ends = self.leaves = self.better = 0

    def bound(self, left: dict[int, int]) -> int:
        """Bins that any packing of ``left`` needs, by the waste that is certain.

        For every limit k up to half: pieces above capacity - k leave no room for others of
        at least k, pieces above half share no bin, and what of the pieces between k and half
        does not fit beside the latter needs bins of its own.
        """
        c = self.capacity
        count = np.zeros(c + 1, np.int64)
        count[list(left)] = list(left.values())
        number, total = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * np.arange(c + 1))]  # of lengths below a place
        half, k = c // 2, np.arange(c // 2 + 1)
        large = number[-1] - number[half + 1]
        middle, filled = number[c - k + 1] - number[half + 1], total[c - k + 1] - total[half + 1]
        over = total[half + 1] - total[k] - (middle * c - filled)
        return int((large + np.maximum(0, -(-over // c))).max())

    def best_fit(self, left: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
        """Best-fit decreasing on the histogram: each piece into the open bin that it fills most."""
        rooms: list[int] = []  # ascending, of open bins that are alike
        alike: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

        def put(bag: tuple[int, ...], times: int, room: int) -> None:
            if not alike[room]:
                insort(rooms, room)
            alike[room].append((bag, times))

        for s in sorted(left, reverse=True):
            n = left[s]
            while n:
                at = bisect_left(rooms, s)
                if at == len(rooms):
                    each = min(self.capacity // s, n)
                    put((s,) * each, n // each, self.capacity - s * each)
                    n -= each * (n // each)
                    continue
                room = rooms[at]
                bag, times = alike[room].pop()
                if not alike[room]:
                    del rooms[at]
                each = min(room // s, n)  # a bin that took one is the fullest that takes the next
                used = min(times, n // each)
                put(bag + (s,) * each, used, room - s * each)
                if used < times:
                    put(bag, times - used, room)
                n -= each * used
        return [x for r in rooms for x in alike[r]]

    @staticmethod
    def _take(left: dict[int, int], bag, times: int) -> None:
        for s in bag:
            left[s] -= times
            if not left[s]:
                del left[s]

    def fillings(self, left: dict[int, int], room: int) -> list[tuple[int, ...]]:
        """Undominated fillings of ``room`` to which nothing can be added, least waste first, at most ``width`` of them."""
        if left.get(room):
            return [(room,)]  # one piece that fits exactly dominates every other filling
        sizes = sorted((s for s in left if s <= room), reverse=True)
        below = [-s for s in sizes]
        found: list[tuple[int, tuple[int, ...]]] = []
        budget = [self.width * 60]

        def extend(at: int, bag: tuple[int, ...], room: int) -> None:
            """Adds copies of one size, as many as fit first, then smaller sizes."""
            budget[0] -= 1
            at = max(at, bisect_left(below, -room))
            for i in range(at, len(sizes)):
                s = sizes[i]
                for k in range(min(room // s, left[s]), 0, -1):
                    extend(i + 1, bag + (s,) * k, room - k * s)
                    if budget[0] <= 0 or len(found) >= self.width * 8:
                        return
            fitting = bisect_left(below, -room)
            if bag and (fitting == len(sizes) or all(bag.count(s) == left[s] for s in sizes[fitting:])):
                found.append((room, bag))

        extend(0, (), room)
        found.sort(key=lambda x: (x[0], len(x[1])))  # those found first have the larger pieces
        kept: list[tuple[int, ...]] = []
        for _, bag in found:
            if not any(_dominates(other, bag) for other in kept):
                kept.append(bag)
                if len(kept) >= self.width:
                    break
        return kept

    def solve(self) -> list[tuple[tuple[int, ...], int]]:
        best = self.best_fit(self.start)
        best_bins, least = sum(n for _, n in best), self.bound(self.start)
        # what is left before the last pattern, that pattern and how often, the chain of patterns with it, bins used
        stack: list[tuple] = [(self.start, (), 0, (), 0)]
        while stack and best_bins > least and self.ends < self.nodes:
            before, bag, times, chain, bins = stack.pop()
            left = dict(before)
            self._take(left, bag, times)
            if not left or bins + self.bound(left) >= best_bins:  # a descent ends here
                self.ends += 1
                self.leaves += not left
                if not left and bins < best_bins:
                    best, best_bins, self.better = _unchain(chain), bins, self.better + 1
                continue
            top = max(left)
            rest = dict(left)
            self._take(rest, (top,), 1)
            branches = []
            for filling in self.fillings(rest, self.capacity - top) or [()]:
                bag = (top, *filling)
                times = min(left[s] // n for s, n in Counter(bag).items())
                branches.append((left, bag, times, (chain, (bag, times)), bins + times))
            stack += reversed(branches)
        return best


def _dominates(other: tuple[int, ...], bag: tuple[int, ...]) -> bool:
    """Whether the pieces of ``bag`` fit, in groups, into single pieces of ``other``; both in falling order."""
    if bag[0] > other[0]:
        return False
    room = list(other)
    for s in bag:
        fits = [r for r in room if r >= s]
        if not fits:
            return False
        tight = min(fits)
        room[room.index(tight)] = tight - s
    return True


def _unchain(chain) -> list[tuple[tuple[int, ...], int]]:
    out = []
    while chain:
        chain, step = chain
        out.append(step)
    return out[::-1]


def _places(solution: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length and pattern: the ranks it serves, its first sequence, offset and copies."""
    used: dict[int, int] = defaultdict(int)
    lines, sequence = [], 0
    for bag, times in solution:
        at = 0
        for s in sorted(set(bag), reverse=True):
            k = bag.count(s)
            lines.append((s, used[s], sequence, at, k))
            used[s] += k * times
            at += k * s
        sequence += times
    table = np.array(sorted(lines), np.int64).reshape(-1, 5)
    return dict(zip(("size", "first", "sequence", "at", "copies"), table.T, strict=True))


def _assign(places: dict[str, np.ndarray]):
    key = places["size"] << 44 | places["first"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(key, size << 44 | rank, side="right") - 1
            past, copies = rank - places["first"][at], places["copies"][at]
            sequence, offset = places["sequence"][at] + past // copies, places["at"][at] + past % copies * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return make


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 1024, end: int = 2, nodes: int = 600, block: int = 2 * BLOCK) -> DataFrame:
    """One row for a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    nodes: descents of the search, each to a complete solution or to where the bound
    ends it, after which the best solution known is taken. block: bytes of text that a task
    handles at a time.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    path = tokenizer or vocabulary(BYTE_JSON)
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    pieces = scratch.keep(source.mapInArrow(lean(_encode(path, end, capacity, block)), _PIECES), "pieces")
    sums = scratch.keep(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "sums")
    totals = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = _places(BinCompletion(totals, capacity, nodes).solve())
    before = sums.selectExpr("length", "task", "sum(n) OVER (PARTITION BY length ORDER BY task) - n AS before")
    ranked = pieces.join(before, ["length", "task"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "before + nth AS rank")
    return ranked.mapInArrow(lean(_assign(places)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
