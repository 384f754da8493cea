"""Blocks of texts as arrays: cuts between pieces, words, and their distinct values.

A block is some rows whose texts hold a bounded number of bytes. Its texts lie one
after the other in one array of bytes, where cuts are found for all places at once;
equal pieces are then found by Arrow's dictionary encoding, so that Python code runs
once for a distinct piece of a block and not for each place where it occurs.

Where a text may be cut without changing its tokens, by the public pattern:

* before a run of white space that follows a visible character, as every match that
  holds the character ends there;
* before the last character of a run that a visible character follows, as the rest of
  the run is a match of its own;
* after that last character, unless it is a space, which joins the match that follows.

Control characters of which regular expressions differ in opinion have no cuts beside
them, and a string that a tokenizer takes out of a text beforehand none before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 8_000_000
_UNICODE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_KIND = np.zeros(256, np.uint8)  # 0 visible, 1 white space, 2 unsure
_KIND[:32] = _KIND[127] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches whose texts hold about ``size`` bytes at most, with those texts; null is empty."""
    for b in batches:
        texts = [b"" if x is None else x for x in b.column("text").cast(pa.binary()).to_pylist()]
        first = held = 0
        for i, text in enumerate(texts):
            if held and held + len(text) > size:
                yield b.slice(first, i - first), texts[first:i]
                first, held = i, 0
            held += len(text)
        if first < len(texts):
            yield b.slice(first), texts[first:]


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, and for each place the number of its value."""
    values = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its length, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Ragged:
    """Arrays of several lengths in one: ``flat``, and where each ends."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, np.asarray(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @staticmethod
    def of(arrays: list, kind) -> Ragged:
        lengths = np.fromiter(map(len, arrays), np.int64, len(arrays))
        flat = np.fromiter(chain.from_iterable(arrays), kind, int(lengths.sum()))
        return Ragged(flat, lengths)

    def take(self, which: np.ndarray) -> Ragged:
        lengths = self.lengths[which]
        return Ragged(self.flat[_runs(self.starts[which], lengths)], lengths)

    def __len__(self) -> int:
        return len(self.lengths)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i] + self.lengths[i]]


class Words:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` of texts. values: distinct ones; index: value of each place; counts: words of each text."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        visible = _KIND[data] != 1
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begin = np.r_[0, ends[:-1]] if len(texts) else ends
        first, last = visible.copy(), visible.copy()
        first[1:] &= ~visible[:-1]
        last[:-1] &= ~visible[1:]
        full = begin < ends
        first[begin[full]], last[ends[full] - 1] = visible[begin[full]], visible[ends[full] - 1]
        starts = np.flatnonzero(first)
        packed = _LOWER[data[visible]]
        offsets = np.r_[0, np.cumsum(np.flatnonzero(last) + 1 - starts)]
        self.values, self.index = _distinct(packed, offsets)
        self.counts = np.searchsorted(starts, ends) - np.searchsorted(starts, begin)


class Pieces:
    """Pieces of texts between cuts. values, index, counts as of words; breaks: whether each piece begins where white space follows a visible character."""

    def __init__(self, texts: list[bytes], apart: bytes | None = None):
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        n = len(data)
        kind = _KIND[data]
        wide = [m.span() for m in _UNICODE_SPACE.finditer(joined)] if n and data.max() >= 0xC2 else []
        for a, z in wide:
            kind[a:z] = 1
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begin = np.r_[0, ends[:-1]] if len(texts) else ends
        space, start, stop = kind == 1, np.zeros(n, bool), np.zeros(n, bool)
        start[begin[begin < ends]] = True
        stop[ends[begin < ends] - 1] = True
        visible, unsure = kind == 0, kind == 2
        breaks = space & np.r_[False, visible[:-1]] & ~start  # the place follows a visible character
        last = space & np.r_[visible[1:], False] & ~stop & (start | ~np.r_[False, unsure[:-1]])  # a visible character follows the place
        for a, z in wide:
            if z < n and last[z - 1]:
                breaks[z - 1] = last[z - 1] = False
                last[a] = True
        cut = breaks | last
        cut[1:] |= (last & (data != 32))[:-1]
        for a, z in wide:
            if last[a]:
                cut[a + 1], cut[z] = False, True
        if apart:
            at = joined.find(apart)
            while at >= 0:
                cut[max(0, at - 4) : at + 1] = False
                at = joined.find(apart, at + 1)
        cut |= start
        offsets = np.flatnonzero(cut)
        self.breaks = (breaks | start)[offsets]
        self.offsets, self.data = np.r_[offsets, n], data
        self.values, self.index = _distinct(data, self.offsets)
        self.counts = np.searchsorted(offsets, ends) - np.searchsorted(offsets, begin)


class Coder:
    """Values of distinct pieces, by ``make``; those of earlier blocks of a task are taken over, up to ``most``.

    make: takes pieces as text, returns their identifiers.
    """

    def __init__(self, make: Callable[[list[str]], Ragged], apart: bytes | None = None, most: int = 600_000):
        self.make, self.apart, self.most = make, apart, most
        self.known, self.all = pa.array([], pa.large_binary()), Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def learn(self, texts: list[bytes]) -> Pieces:
        """The block's pieces, whose values ``of`` then holds."""
        pieces = Pieces(texts, self.apart)
        at = pc.index_in(pieces.values, value_set=self.known) if len(self.known) else pa.nulls(len(pieces.values), pa.int32())
        old = at.is_valid().to_numpy(zero_copy_only=False)
        fresh = pieces.values.take(pa.array(np.flatnonzero(~old)))
        made = self.make([x.decode("utf-8", "surrogatepass") for x in fresh.to_pylist()])
        where = np.empty(len(old), np.int64)
        where[~old] = np.arange(len(fresh)) + len(self.all)
        where[old] = at.drop_null().to_numpy()
        both = Ragged(np.concatenate([self.all.flat, made.flat]), np.r_[self.all.lengths, made.lengths])
        self.of = both.take(where)
        if len(both) <= self.most:
            self.known, self.all = pa.concat_arrays([self.known, fresh]), both
        else:
            self.known, self.all = pieces.values, self.of
        return pieces

    def ids(self, texts: list[bytes]) -> Ragged:
        """Identifiers of each text."""
        pieces = self.learn(texts)
        got = self.of.take(pieces.index)
        sums = np.r_[0, np.cumsum(got.lengths)]
        first = np.r_[0, np.cumsum(pieces.counts)]
        return Ragged(got.flat, sums[first[1:]] - sums[first[:-1]])
