"""Removal of repeated byte strings with a column-wise multi-document suffix order.

Every byte covered by a string of ``length`` bytes that also starts anywhere else goes.

1. Anchors. The anchor of a window of ``length`` bytes is the leftmost of its
   ``gram``-byte strings with the smallest hash. It depends on the window alone, so
   equal windows have anchors at equal places. Windows of a text that follow each
   other mostly share their anchor; the text becomes pieces, one for each anchor and
   its windows. Anchors that occur once in the corpus cannot lie in a repeat; the
   others' pieces go on, equal ones counted instead of repeated.
2. Columns. The pieces whose anchors hash to one bucket are documents of a
   collection, aligned at their anchors. Columns are read from right to left; each
   round inserts one symbol for each document in front of its suffix, which sorts the
   suffixes anew by one stable distribution (the column's Burrows-Wheeler transform
   is the symbols in the old order) and updates the common prefixes of neighbours by
   minima over the old ones. As equal windows have equal places, only suffixes of the
   same column have to be compared. Between steps, pieces lie in sequential messages of
   the shuffle; a task makes some columns at a time from them, and holds those, the order
   and the prefixes.
3. Spans. A window is repeated if its suffix shares ``length`` bytes with a neighbour
   or its piece occurs twice. Spans return to their texts and are cut out.

All steps move packed arrays between buckets of bounded size. A passage that very many
texts hold is one piece for each bucket of texts.

Defined cases: null text is empty; texts below ``length`` bytes lose nothing; repeated
rows and identifiers are rows of their own, so exact copies of that length remove each
other; what is left may split a character, and is bytes; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column_bytes, documents, hash_buckets, lean, lean_group, pack, splits, squeeze, unpack, unsqueeze

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("rest", pa.string()), ("body", pa.binary())])
_DDL = "bucket int, kind int, doc_id long, row long, rest string, body binary"
_TEXT, _NOTE = 0, 1
SEGMENT = 1 << 20


def _symbols() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SYMBOLS = _symbols()


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place; ``gram`` is a power of two."""
    h, k, factor = _SYMBOLS[data], 1, _BASE
    while k < gram:
        h = h[:-k] * factor + h[k:]
        factor, k = factor * factor, 2 * k
    h = (h ^ (h >> np.uint64(32))) * _SYMBOLS[7]
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, length: int, gram: int):
    """Hash, place, first and last window of every anchor, in order of windows."""
    found = []
    with np.errstate(over="ignore"):
        for start in range(0, len(data) - length + 1, SEGMENT):
            part = data[start : start + SEGMENT + length - 1]
            h = gram_hashes(part, gram)
            low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
            width, k = length - gram + 1, 1
            while 2 * k <= width:
                low, k = np.minimum(low[:-k], low[k:]), 2 * k
            if k < width:
                low = np.minimum(low[: len(low) - (width - k)], low[width - k :])
            at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[first[1:], len(at)] - 1
            found.append((h[at[first]], at[first] + start, first + start, last + start))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def _dealt(keys: np.ndarray, buckets: int):
    order = np.argsort(keys, kind="stable")
    edges = np.searchsorted(keys[order], np.arange(buckets + 1))
    return [(k, order[edges[k] : edges[k + 1]]) for k in range(buckets) if edges[k] < edges[k + 1]]


def _notes(buckets: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    none = pa.nulls(len(buckets), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([_NOTE] * len(buckets), pa.int32()), none, none, pa.nulls(len(buckets), pa.string()), pa.array(bodies, pa.binary())], schema=_MESSAGE)


def _squeeze_texts(buckets: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("row").to_numpy(zero_copy_only=False)
            own = ((row.astype(np.uint64) * _BASE) >> np.uint64(33)) % np.uint64(buckets)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([_TEXT] * len(row), pa.int32()), b.column("doc_id"), b.column("row"), b.column("rest"), pa.array([squeeze(x) for x in column_bytes(b, "text")], pa.binary())], schema=_MESSAGE)

    return make


def _send_anchors(length: int, gram: int, buckets: int, limit: int = 1_000_000):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            h, rows, at, first, last = (np.concatenate([x[i] for x in held]) for i in range(5))
            held, size = [], 0
            dealt = _dealt((h % np.uint64(buckets)).astype(np.int64), buckets)
            return _notes([k for k, _ in dealt], [pack(h[i], rows[i], at[i].astype(np.uint32), (at[i] - first[i]).astype(np.uint16), (at[i] - last[i]).astype(np.uint16)) for _, i in dealt])

        for b in batches:
            for row, body in zip(b.column("row").to_pylist(), b.column("body").to_pylist(), strict=True):
                data = np.frombuffer(unsqueeze(body), np.uint8)
                if len(data) >= length:
                    h, at, first, last = anchors(data, length, gram)
                    held.append((h, np.full(len(h), row), at, first, last))
                    size += len(h)
                    if size >= limit:
                        yield flush()
        if held:
            yield flush()

    return make


def _repeated_anchors(buckets: int):
    def repeated(key: tuple, table: pa.Table) -> pa.Table:
        h, rows, at, first, last = (np.concatenate(x) for x in zip(*map(unpack, table.column("body").to_pylist()), strict=True))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        own = (((rows[order].astype(np.uint64) * _BASE) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        dealt = [(k, order[i]) for k, i in _dealt(own, buckets)]
        return pa.Table.from_batches([_notes([k for k, _ in dealt], [pack(h[i], rows[i], at[i], first[i], last[i]) for _, i in dealt])])

    return repeated


def _split(table: pa.Table) -> tuple[dict[int, tuple[int | None, str, bytes]], list[list[np.ndarray]]]:
    texts, notes = {}, []
    for kind, doc, row, rest, body in zip(*(table.column(c).to_pylist() for c in ("kind", "doc_id", "row", "rest", "body")), strict=True):
        if kind == _TEXT:
            texts[row] = (doc, rest, body)
        else:
            notes.append(unpack(body))
    return texts, notes


def _cut_pieces(length: int, buckets: int):
    """Distinct pieces of a bucket's texts, each with the places where it occurs."""

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        texts, notes = _split(table)
        if not notes:
            return pa.Table.from_batches([], schema=_MESSAGE)
        h, rows, at, first, last = (np.concatenate(x) for x in zip(*notes, strict=True))
        order = np.argsort(rows, kind="stable")
        h, rows = h[order], rows[order]
        at = at[order].astype(np.int64)
        begin, end = at - first[order], at - last[order].astype(np.int64) + length
        known: dict[tuple[int, bytes], int] = {}
        which = np.empty(len(h), np.int64)
        current, data = None, b""
        for i, (row, a, z, place) in enumerate(zip(rows.tolist(), begin.tolist(), end.tolist(), (at - begin).tolist(), strict=True)):
            if row != current:
                current, data = row, unsqueeze(texts[row][2])
            which[i] = known.setdefault((place, data[a:z]), len(known))
        texts.clear()
        pieces = list(known)
        order = np.argsort(which, kind="stable")
        starts = np.searchsorted(which[order], np.arange(len(pieces) + 1))
        hashes = h[order][starts[:-1]]
        sent = []
        for k, own in _dealt((hashes % np.uint64(buckets)).astype(np.int64), buckets):
            uses = np.concatenate([order[starts[p] : starts[p + 1]] for p in own])
            sent.append((k, pack(np.array([pieces[p][0] for p in own], np.uint16), np.array([len(pieces[p][1]) for p in own], np.uint16), np.frombuffer(b"".join(pieces[p][1] for p in own), np.uint8), (starts[own + 1] - starts[own]).astype(np.uint32), rows[uses], begin[uses].astype(np.uint32))))
        return pa.Table.from_batches([_notes([k for k, _ in sent], [x for _, x in sent])])

    return cut


def repeated_windows(pieces: list[tuple[int, bytes]], length: int) -> np.ndarray:
    """Which windows of each piece another piece holds: [piece, place of the window's start].

    pieces: (place of the anchor, bytes), all different. The columns are aligned at the anchors.
    """
    n = len(pieces)
    left = max(p for p, _ in pieces)
    right = max(len(x) - p for p, x in pieces)
    width = left + right
    out = np.zeros((n, max(1, max(len(x) for _, x in pieces) - length + 1)), bool)
    shift = np.array([left - p for p, _ in pieces], np.int64)
    rows = max(1, (1 << 20) // n)
    lengths = np.array([len(x) for _, x in pieces], np.int64)
    flat = np.frombuffer(b"".join(x for _, x in pieces), np.uint8)
    starts = np.cumsum(lengths) - lengths

    def columns(begin: int, end: int) -> np.ndarray:
        """Symbols of the columns [begin, end), a row for each; 0 stands for the end of a text."""
        at = np.arange(begin, end)[:, None] - shift
        inside = (at >= 0) & (at < lengths)
        return np.where(inside, flat[np.where(inside, starts + at, 0)].astype(np.uint16) + 1, 0)

    order, common = np.arange(n), np.zeros(n, np.int16)  # common[i]: of order[i - 1] and order[i]
    last = width
    while last > 0:
        begin = max(0, last - rows)
        block = columns(begin, last)
        for c in range(last - 1, begin - 1, -1):
            symbol = block[c - begin][order]
            by = np.argsort(symbol, kind="stable")
            ordered = symbol[by]
            new = np.zeros(n, np.int16)
            edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if z - a > 1 and ordered[a]:
                    at = by[a:z]  # old places, ascending
                    new[a + 1 : z] = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1) + 1
            order, common = order[by], np.minimum(new, length)
            hit = common >= length
            hit = order[hit | np.r_[hit[1:], False]]
            out[hit, c - shift[hit]] = True
        last = begin
    return out


def _columns(length: int, buckets: int):
    def columns(key: tuple, table: pa.Table) -> pa.Table:
        known: dict[tuple[int, bytes], int] = {}
        which, whose, where = [], [], []
        for body in table.column("body").to_pylist():
            places, lengths, raw, times, rows, begins = unpack(body)
            flat, ends = raw.tobytes(), np.cumsum(lengths.astype(np.int64)).tolist()
            own = [known.setdefault((p, flat[a:z]), len(known)) for p, a, z in zip(places.tolist(), [0, *ends[:-1]], ends, strict=True)]
            which.append(np.repeat(own, times))
            whose.append(rows)
            where.append(begins)
        which, whose, where = np.concatenate(which), np.concatenate(whose), np.concatenate(where).astype(np.int64)
        pieces = list(known)
        times = np.bincount(which, minlength=len(pieces))
        windows = np.array([len(x) - length + 1 for _, x in pieces], np.int64)
        flags = repeated_windows(pieces, length)
        flags[times > 1] = True
        flags &= np.arange(flags.shape[1]) < windows[:, None]
        padded = np.pad(flags, ((0, 0), (1, 1))).astype(np.int8)
        change = np.diff(padded, axis=1)
        piece, first = np.nonzero(change == 1)
        _, after = np.nonzero(change == -1)
        runs = np.searchsorted(piece, np.arange(len(pieces) + 1))
        count = (runs[1:] - runs[:-1])[which]
        total = int(count.sum())
        use = np.repeat(np.arange(len(which)), count)
        run = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + runs[which[use]]
        row, begin, end = whose[use], where[use] + first[run], where[use] + after[run] + length - 1
        own = (((row.astype(np.uint64) * _BASE) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        dealt = _dealt(own, buckets)
        return pa.Table.from_batches([_notes([k for k, _ in dealt], [pack(row[i], begin[i].astype(np.uint32), end[i].astype(np.uint32)) for _, i in dealt])])

    return columns


_RESULT = pa.schema([("doc_id", pa.int64()), ("rest", pa.string()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def merge_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [begin, end); runs that touch are one."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    first = np.r_[True, begin[1:] > reach[:-1]]
    return begin[first], reach[np.r_[first[1:], True]]


def _cut_out(key: tuple, table: pa.Table) -> pa.Table:
    texts, notes = _split(table)
    spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if notes:
        rows, begin, end = (np.concatenate(x) for x in zip(*notes, strict=True))
        order = np.argsort(rows, kind="stable")
        rows, begin, end = rows[order], begin[order].astype(np.int64), end[order].astype(np.int64)
        edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1], True])
        spans = {int(rows[a]): merge_spans(begin[a:z], end[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)} if len(rows) else {}
    out: list[tuple] = []
    for row, (doc, rest, body) in texts.items():
        data = unsqueeze(body)
        begin, end = spans.get(row, ((), ()))
        cuts = [0, *(x for pair in zip(begin, end, strict=True) for x in map(int, pair)), len(data)]
        kept = b"".join(data[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True))
        out.append((doc, rest, len(data), len(data) - len(kept), len(begin), kept))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, _RESULT, strict=True)], schema=_RESULT)


def suffix_dedup(docs: DataFrame, *, length: int = 200, gram: int = 64, buckets: int | None = None) -> DataFrame:
    """doc_id, rest, n_bytes, n_removed, n_spans, kept (bytes) for every row of ``docs``.

    gram: bytes of an anchor, a power of two below ``length``. rest: the other columns as JSON.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*others)) if others else F.lit(None).cast("string")
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), rest.alias("rest"), "text")
    count = buckets or hash_buckets(splits(source), 64)
    texts = scratch.keep(source.mapInArrow(lean(_squeeze_texts(count)), _DDL), "texts")
    sent = texts.mapInArrow(lean(_send_anchors(length, gram, count)), _DDL).groupBy("bucket")
    repeated = sent.applyInArrow(lean_group(_repeated_anchors(count)), _DDL)
    pieces = texts.unionByName(repeated).groupBy("bucket").applyInArrow(lean_group(_cut_pieces(length, count)), _DDL)
    spans = pieces.groupBy("bucket").applyInArrow(lean_group(_columns(length, count)), _DDL)
    return texts.unionByName(spans).groupBy("bucket").applyInArrow(lean_group(_cut_out), "doc_id long, rest string, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
