"""Scoring with a gated recurrent language model over words, in numpy.

Tokens are lower-cased words and one end for each text. The output softmax is
factored by classes: P(word | state) = P(class | state) * P(word | class, state). The
most frequent words form classes by frequency whose words have weights of their own;
all other words fall into classes by how they begin, within which a word has its
smoothed share of the class (an unseen word that of one unseen type), so that the
probabilities of all words sum to one over the known words and one unseen word of each class.

* Counts cover every token of every training text. Tasks pre-aggregate, send packed
  counts by a hash of the word, and a bucket sums its words; no word's total is ever
  collected except those of a fixed number of frequent words.
* Weights are fitted by all tasks at once: each runs over all its training texts with
  the state carried from window to window, back-propagates through every window
  (truncated at its start), and the weights are averaged, in groups first, weighted
  by the tokens that gave gradients.
* Texts are scored whole: many lie side by side in lanes, and the state is carried
  through all windows of a text. Words outside the frequent ones get their counts
  from the bucket of their hash, which returns one sum for each text.

Defined cases: null or blank texts have the end token only; a null identifier counts
as the empty text for the fold; without training texts all counts are zero; repeated
rows are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapreplace, nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK, Ragged, Words, blocks
from .common import Scratch, documents, hash_buckets, pack, remainder, splits, unpack

END = b"\n"
MOD, HELD = 7, 2
_MESSAGE = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("body", pa.binary())])
_DDL = "bucket int, block long, body binary"


@dataclass(frozen=True)
class Shape:
    """hidden: state size. classes, words: frequent classes and their words. tails: classes of other words."""

    hidden: int = 16
    classes: int = 32
    words: int = 16
    tails: int = 64
    frequent: int = 65536
    window: int = 32

    @property
    def heads(self) -> int:
        return self.classes * self.words


def tail_class(word: bytes, tails: int) -> int:
    return zlib.crc32(word[:2]) % tails


def tail_classes(words: pa.Array, tails: int) -> np.ndarray:
    """The same for an array of words (64-bit offsets), none of them empty."""
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = raw[edges[:-1]].astype(np.int64)
    second = np.where(np.diff(edges) > 1, raw[np.minimum(edges[:-1] + 1, max(0, len(raw) - 1))].astype(np.int64), 256)
    pair, at = np.unique(first * 257 + second, return_inverse=True)
    starts = (bytes([p // 257]) if p % 257 == 256 else bytes(divmod(p, 257)) for p in pair.tolist())
    return np.fromiter((tail_class(s, tails) for s in starts), np.int64, len(pair))[at]


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, words), "<u4", len(words)), np.frombuffer(b"".join(words), np.uint8)


def _parted(lengths: np.ndarray, raw: np.ndarray) -> list[bytes]:
    flat, ends = raw.tobytes(), np.cumsum(lengths.astype(np.int64))
    return [flat[a:z] for a, z in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def _by_bucket(words: list[bytes], buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places of its words) for each bucket that has any."""
    own = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(own, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0, True]) if len(words) else [0]
    return [(int(own[order[a]]), order[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _messages(buckets: list[int], blocks_of: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blocks_of, pa.int64()), pa.array(bodies, pa.binary())], schema=_MESSAGE)


def _count(buckets: int, most: int = 700_000):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words, numbers = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            out = [(k, pack(*_joined([words[i] for i in at]), numbers[at])) for k, at in _by_bucket(words, buckets)]
            counts.clear()
            return _messages([k for k, _ in out], [0] * len(out), [x for _, x in out])

        for b, texts in blocks(batches, 2 * BLOCK):
            own = [t for d, t in zip(b.column("doc_id").to_pylist(), texts, strict=True) if remainder(d, MOD) != HELD]
            if own:
                words = Words(own)
                for w, n in zip(words.values.to_pylist(), np.bincount(words.index, minlength=len(words.values)).tolist(), strict=True):
                    counts[w] = counts.get(w, 0) + n
                counts[END] = counts.get(END, 0) + len(own)
                if len(counts) > most:
                    yield flush()
        if counts:
            yield flush()

    return make


_TOTALS = pa.schema([("bucket", pa.int32()), ("body", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("top", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())), ("tails", pa.list_(pa.float64()))])
_TOTALS_DDL = "bucket int, body binary, tokens long, types long, top array<binary>, times array<long>, tails array<double>"


def _total(tails: int, top: int):
    def total(key: tuple, table: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        for body in table.column("body").to_pylist():
            lengths, raw, numbers = unpack(body)
            for w, n in zip(_parted(lengths, raw), numbers.tolist(), strict=True):
                counts[w] = counts.get(w, 0) + n
        words, numbers = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
        best = nsmallest(top, range(len(words)), key=lambda i: (words[i] != END, -numbers[i], words[i]))  # the end is always among them
        mass = np.bincount(np.fromiter((tail_class(w, tails) for w in words), np.int64, len(words)), weights=numbers + 1, minlength=tails)
        row = [[key[0].as_py()], [pack(*_joined(words), numbers)], [int(numbers.sum())], [len(words)], [[words[i] for i in best]], [[int(numbers[i]) for i in best]], [mass.tolist()]]
        return pa.table([pa.array(c, f.type) for c, f in zip(row, _TOTALS, strict=True)], schema=_TOTALS)

    return total


@dataclass
class Vocabulary:
    """ids: of frequent words. cls, place: output class and place in it (heads only). logs: log10(count + 1)."""

    shape: Shape
    ids: dict[bytes, int]
    cls: np.ndarray
    logs: np.ndarray
    known: np.ndarray
    tail_log: np.ndarray
    tokens: int
    types: int

    @property
    def base(self) -> int:
        return len(self.logs)

    @functools.cached_property
    def values(self) -> pa.Array:
        """Frequent words in order of their identifiers."""
        return pa.array(list(self.ids), pa.large_binary())

    @staticmethod
    def build(shape: Shape, top: list[tuple[bytes, int]], mass: np.ndarray, tokens: int, types: int) -> Vocabulary:
        counts = dict(top)
        order = [END, *(w for w, _ in sorted(top, key=lambda x: (-x[1], x[0])) if w != END)][: shape.frequent]
        heads = order[: shape.heads]
        cls = np.array([i // shape.words for i in range(len(heads))] + [shape.classes + tail_class(w, shape.tails) for w in order[len(heads) :]], np.int64)
        number = np.array([counts.get(w, 0) for w in order], np.float64)
        mass = mass.copy()
        for w in heads:
            if w in counts:
                mass[tail_class(w, shape.tails)] -= counts[w] + 1
        return Vocabulary(shape, {w: i for i, w in enumerate(order)}, cls, np.log10(number + 1), number > 0, np.log10(np.maximum(mass, 0) + 1), tokens, types)


def _lower(logits: np.ndarray) -> None:
    """Shifts rows of logits so that exp neither overflows nor vanishes: all alike if they are close, else each by its largest."""
    if logits.size:
        top = logits.max()
        logits -= top if top - logits.min() < 60 else logits.max(axis=1, keepdims=True)


class Gated:
    """A gated recurrent unit with a class-factored softmax; all weights in one flat vector."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None, seed: int = 11):
        self.shape, h, inputs = shape, shape.hidden, shape.heads + shape.tails
        c = shape.classes + shape.tails
        self.sizes = {"g": (inputs, 3 * h), "u": (h, 3 * h), "wc": (h, c), "bc": (c,), "wo": (shape.classes, h, shape.words), "bo": (shape.classes, shape.words)}
        total = sum(int(np.prod(s)) for s in self.sizes.values())
        self.flat = np.zeros(total, np.float32) if flat is None else flat.astype(np.float32)
        at = 0
        for name, size in self.sizes.items():
            setattr(self, name, self.flat[at : at + int(np.prod(size))].reshape(size))
            at += int(np.prod(size))
        if flat is None:
            rng = np.random.default_rng(seed)
            self.g[:] = rng.normal(0, 0.3, self.g.shape)
            self.u[:] = rng.normal(0, 0.3, self.u.shape)
            self.g[:, :h] -= 1.5  # the state is kept for long at first

    def forward(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """x: inputs [steps, lanes]; fresh: where a text begins. Returns the state after each step, and the gates (state before, z and r, c) of each."""
        n = self.shape.hidden
        states = np.empty((len(x), *h.shape), np.float32)
        kept = (np.empty_like(states), np.empty((*x.shape, 2 * n), np.float32), np.empty_like(states)) if keep else None
        both, own = np.ascontiguousarray(self.u[:, : 2 * n]), np.ascontiguousarray(self.u[:, 2 * n :])
        begins = fresh.any(axis=1)
        for t in range(len(x)):
            if begins[t]:
                h = h * ~fresh[t][:, None]
            gx = self.g[x[t]]
            zr = h @ both
            zr += gx[:, : 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c = (zr[:, n:] * h) @ own
            c += gx[:, 2 * n :]
            np.tanh(c, out=c)
            if keep:
                kept[0][t], kept[1][t], kept[2][t] = h, zr, c
            c -= h
            c *= zr[:, :n]
            h = np.add(h, c, out=states[t])
        return states, kept

    def log_probs(self, states: np.ndarray, cls: np.ndarray, place: np.ndarray, scale: float | None = None):
        """Natural log of P(class) * P(word | class) for rows of states; place is -1 for tail classes.

        With ``scale`` also P(class) times it, the rows of head classes in order of class, where each class begins, and P(word | class) of those rows times it.
        """
        e = states @ self.wc
        e += self.bc
        _lower(e)
        row = np.arange(len(cls))
        out = e[row, cls]
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], e.dtype)
        out -= np.log(total)
        head = np.flatnonzero(place >= 0)
        head = head[np.argsort(cls[head].astype(np.int16), kind="stable")]
        edges = np.searchsorted(cls[head], np.arange(self.shape.classes + 1))
        rows, inner = states[head], np.empty((len(head), self.shape.words), e.dtype)
        for k in range(self.shape.classes):
            if edges[k] < edges[k + 1]:
                inner[edges[k] : edges[k + 1]] = rows[edges[k] : edges[k + 1]] @ self.wo[k] + self.bo[k]
        _lower(inner)
        chosen = inner[np.arange(len(head)), place[head]]
        np.exp(inner, out=inner)
        ti = inner @ np.ones(inner.shape[1], inner.dtype)
        out[head] += chosen - np.log(ti)
        if scale is None:
            return out
        e *= (scale / total)[:, None]
        inner *= (scale / ti)[:, None]
        return out, e, head, edges, inner

    def gradient(self, x, fresh, h, cls, place, use) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient of the mean negative log-likelihood over the window, truncated at its start; the next state; the loss."""
        n, (steps, lanes) = self.shape.hidden, x.shape
        states, (before, zr, c) = self.forward(x, fresh, h, keep=True)
        # the state after reading x[t] predicts target t
        own = np.flatnonzero(use.ravel())
        rows, cls, place = states.reshape(-1, n)[own], cls.ravel()[own], place.ravel()[own]
        scale = np.float32(1 / max(1, len(own)))
        out, p, head, edges, q = self.log_probs(rows, cls, place, scale)
        grad = Gated(self.shape, np.zeros_like(self.flat))
        p[np.arange(len(own)), cls] -= scale
        grad.wc[:] = rows.T @ p
        grad.bc[:] = np.ones(len(p), p.dtype) @ p
        back = p @ self.wc.T
        q[np.arange(len(head)), place[head]] -= scale
        inner, back_head = rows[head], np.empty((len(head), n), np.float32)
        for k in range(self.shape.classes):
            at = slice(edges[k], edges[k + 1])
            if at.start < at.stop:
                grad.wo[k] = inner[at].T @ q[at]
                grad.bo[k] = q[at].sum(axis=0)
                back_head[at] = q[at] @ self.wo[k].T
        back[head] += back_head
        d_out = np.zeros((steps * lanes, n), np.float32)
        d_out[own] = back
        d_out = d_out.reshape(steps, lanes, n)
        z, r = zr[..., :n], zr[..., n:]
        left = 1 - z
        by_z, by_c, by_r = (c - before) * z * left, z * (1 - c * c), before * r * (1 - r)
        d = np.empty((steps, lanes, 3 * n), np.float32)
        both, last = np.ascontiguousarray(self.u[:, : 2 * n].T), np.ascontiguousarray(self.u[:, 2 * n :].T)
        begins = fresh.any(axis=1)
        dh = np.zeros((lanes, n), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += d_out[t]
            dt = d[t]
            np.multiply(dh, by_z[t], out=dt[:, :n])
            dc = dh * by_c[t]
            dt[:, 2 * n :] = dc
            d_rh = dc @ last
            np.multiply(d_rh, by_r[t], out=dt[:, n : 2 * n])
            d_rh *= r[t]
            dh *= left[t]
            dh += d_rh
            dh += dt[:, : 2 * n] @ both
            if begins[t]:
                dh *= ~fresh[t][:, None]
        d = d.reshape(-1, 3 * n)
        before = before.reshape(-1, n)
        grad.u[:, : 2 * n] = before.T @ d[:, : 2 * n]
        grad.u[:, 2 * n :] = (r.reshape(-1, n) * before).T @ d[:, 2 * n :]
        read = x.ravel()
        order = np.argsort(read.astype(np.int16) if len(self.g) < 1 << 15 else read, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(read[order]) != 0])
        grad.g[read[order[starts]]] = np.add.reduceat(d[order], starts, axis=0)
        return grad.flat, states[-1], -float(out.sum()) * float(scale)


class Lanes:
    """Texts side by side in lanes, each lane one text after the other; memory is in proportion to the tokens.

    ids: tokens of all texts; lengths: of each text. ``place`` is where a text begins in ``target``.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, lanes: int, words: Vocabulary, longest_first: bool = True):
        order = np.argsort(-lengths, kind="stable") if longest_first else np.arange(len(lengths))
        heap = [(0, k) for k in range(max(1, min(lanes, len(lengths))))]
        lane = np.empty(len(lengths), np.int64)
        for i in order.tolist():
            at, k = heap[0]
            lane[i] = k
            heapreplace(heap, (at + int(lengths[i]), k))
        sizes = np.zeros(len(heap), np.int64)
        for at, k in heap:
            sizes[k] = at
        by_size = np.argsort(-sizes, kind="stable")  # lanes that are still open are the first ones
        rank = np.empty(len(heap), np.int64)
        rank[by_size] = np.arange(len(heap))
        order = order[np.argsort(rank[lane[order]], kind="stable")]
        self.sizes = sizes[by_size]
        self.starts = np.cumsum(self.sizes) - self.sizes
        own = Ragged(ids, lengths).take(order)
        self.target = own.flat
        self.place = np.empty(len(lengths), np.int64)
        self.place[order] = own.starts
        shape = words.shape
        cls_of = np.r_[words.cls, shape.classes + np.arange(shape.tails)].astype(np.int16)
        heads = min(shape.heads, words.base)
        place_of = np.full(len(cls_of), -1, np.int16)
        place_of[:heads] = np.arange(heads) % shape.words
        self.cls, self.within = cls_of[self.target], place_of[self.target]
        read = np.where(self.within >= 0, self.target, shape.heads + self.cls - shape.classes).astype(np.int32)
        self.fresh = np.zeros(len(read), bool)
        self.fresh[own.starts] = True
        self.read = np.r_[0, read[:-1]].astype(np.int32)
        self.read[self.fresh] = 0  # the end token, where a text begins

    def windows(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places [steps, open lanes], and which of them hold a token; open lanes only become fewer."""
        for at in range(0, int(self.sizes[0]), size):
            open_lanes = int((self.sizes > at).sum())
            sizes, step = self.sizes[:open_lanes], np.arange(at, min(at + size, int(self.sizes[0])))[:, None]
            use = step < sizes
            yield np.where(use, self.starts[:open_lanes] + step, 0), use


class Texts:
    """Identifiers of a block's tokens, ends included, and the rare words of its texts.

    pairs: word, text and how often, for words that are not frequent; the word is its number in ``rare``.
    """

    def __init__(self, texts: list[bytes], words: Vocabulary, rare: bool):
        found = Words(texts)
        at = pc.index_in(found.values, value_set=words.values)
        number = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(number < 0)
        rest = found.values.take(pa.array(new))
        number[new] = words.base + tail_classes(rest, words.shape.tails)
        self.lengths = found.counts + 1
        self.ids = np.insert(number[found.index], np.cumsum(found.counts), 0)
        if rare:
            text = np.repeat(np.arange(len(texts)), found.counts)
            own = np.flatnonzero(number[found.index] >= words.base)
            spot = np.empty(len(number), np.int64)
            spot[new] = np.arange(len(new))
            self.rare = rest.to_pylist()
            key, self.times = np.unique(spot[found.index[own]] * len(texts) + text[own], return_counts=True)
            self.word, self.text = np.divmod(key, max(1, len(texts)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """(number of the block among all, rows, texts)."""
    number = 0
    for b, texts in blocks(batches, 2 * BLOCK):
        yield b.column("part")[0].as_py() << 24 | number, b, texts
        number += 1


_WEIGHTS = pa.schema([("part", pa.int32()), ("body", pa.binary()), ("seen", pa.float64())])
_WEIGHTS_DDL = "part int, body binary, seen double"


def _fit(words: Vocabulary, start: np.ndarray, every: int, lanes: int, rate: float, groups: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, model = words.shape, Gated(words.shape, start.copy())
        m, v, step, seen, part = np.zeros_like(start), np.zeros_like(start), 0, 0, 0
        for block, b, texts in _parts(batches):
            part = block >> 24
            texts = [t for d, t in zip(b.column("doc_id").to_pylist(), texts, strict=True) if remainder(d, MOD) != HELD]
            if not texts:
                continue
            own = Texts(texts, words, rare=False)
            dealt = Lanes(own.ids, own.lengths, lanes, words, longest_first=False)
            h = np.zeros((len(dealt.sizes), shape.hidden), np.float32)
            for k, (at, use) in enumerate(dealt.windows(shape.window)):
                h = h[: at.shape[1]]
                if (k + part) % every:
                    h = model.forward(dealt.read[at], dealt.fresh[at], h)[0][-1]
                    continue
                grad, h, _ = model.gradient(dealt.read[at], dealt.fresh[at], h, dealt.cls[at], dealt.within[at], use)
                seen += int(use.sum())
                norm = float(np.sqrt(grad @ grad))
                step += 1
                grad *= min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                model.flat -= (rate * min(1.0, step / 10) / (1 + step / 200) / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part % groups], pa.int32()), pa.array([pack(model.flat)]), pa.array([float(seen)])], schema=_WEIGHTS)

    return make


def _average(key: tuple, table: pa.Table) -> pa.Table:
    seen = table.column("seen").to_pylist()
    total = sum(n * unpack(x)[0].astype(np.float64) for n, x in zip(seen, table.column("body").to_pylist(), strict=True)) / sum(seen)
    return pa.table([[key[0].as_py()], [pack(total)], [sum(seen)]], schema=_WEIGHTS)


def _score(words: Vocabulary, weights: np.ndarray, buckets: int, lanes: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, model = words.shape, Gated(words.shape, weights)
        base_log = np.log10(words.tokens + words.types + 1)
        log_of = np.r_[words.logs, np.zeros(shape.tails)]
        known_of = np.r_[words.known, np.zeros(shape.tails, bool)].astype(np.int64)
        heads = min(shape.heads, words.base)
        inner_of = log_of * (np.arange(len(log_of)) >= heads) - np.r_[np.zeros(heads), words.tail_log[words.cls[heads:] - shape.classes], words.tail_log]
        for block, b, texts in _parts(batches):
            own = Texts(texts, words, rare=True)
            dealt = Lanes(own.ids, own.lengths, lanes, words)
            h, got = np.zeros((len(dealt.sizes), shape.hidden), np.float32), np.zeros(len(own.ids))
            for at, use in dealt.windows(shape.window):
                states, _ = model.forward(dealt.read[at], dealt.fresh[at], h[: at.shape[1]])
                h, spots, at = states[-1], np.flatnonzero(use.ravel()), at.ravel()
                at = at[spots]
                got[at] = model.log_probs(states.reshape(-1, shape.hidden)[spots], dealt.cls[at], dealt.within[at])
            begin = np.cumsum(own.lengths) - own.lengths
            inner, base, known = (np.add.reduceat(x[own.ids], begin) for x in (inner_of, log_of, known_of))
            by_place = np.argsort(dealt.place)
            score = np.empty(len(texts))
            score[by_place] = np.add.reduceat(got, dealt.place[by_place])
            docs = b.column("doc_id").to_pylist()
            head = pack(np.array([d is None for d in docs], np.uint8), np.array([d or 0 for d in docs], np.int64), np.array([remainder(d, MOD) == HELD for d in docs], np.uint8), score / np.log(10) + inner, base - own.lengths * base_log, known.astype(float), own.lengths.astype(float))
            out = [(zlib.crc32(b"%d" % block) % buckets, head)]
            order = np.argsort(own.word, kind="stable")
            edges = np.searchsorted(own.word[order], np.arange(len(own.rare) + 1))
            for k, at in _by_bucket(own.rare, buckets):
                pairs = Ragged(order, np.diff(edges)).take(at)
                out.append((k, pack(*_joined([own.rare[i] for i in at.tolist()]), pairs.lengths.astype(np.uint32), own.text[pairs.flat].astype(np.uint32), own.times[pairs.flat].astype(np.uint32))))
            yield _messages([k for k, _ in out], [block] * len(out), [x for _, x in out])

    return make


def _look_up(key: tuple, table: pa.Table) -> pa.Table:
    """The bucket's counts (block null) against the rare words of all blocks: two sums for each text."""
    blocks_of, bodies = table.column("block").to_pylist(), table.column("body").to_pylist()
    counts: dict[bytes, int] = {}
    for block, body in zip(blocks_of, bodies, strict=True):
        if block is None:
            lengths, raw, numbers = unpack(body)
            counts.update(zip(_parted(lengths, raw), numbers.tolist(), strict=True))
    out_blocks, out = [], []
    for block, body in zip(blocks_of, bodies, strict=True):
        if block is None:
            continue
        parts = unpack(body)
        if len(parts) == 5:
            lengths, raw, pairs, texts, times = parts
            c = np.repeat(np.fromiter((counts.get(w, 0) for w in _parted(lengths, raw)), np.float64, len(lengths)), pairs)
            own, at = np.unique(texts, return_inverse=True)
            body = pack(own, np.bincount(at, weights=times * np.log10(c + 1)), np.bincount(at, weights=times * (c > 0)))
        out_blocks.append(block)
        out.append(body)
    return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(out_blocks, pa.int64()), pa.array(out, pa.binary())], schema=_MESSAGE)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finish(key: tuple, table: pa.Table) -> pa.Table:
    parts = [unpack(x) for x in table.column("body").to_pylist()]
    null, docs, held, score, base, known, lengths = next(p for p in parts if len(p) == 7)
    score, base, known = score.copy(), base.copy(), known.copy()
    for p in parts:
        if len(p) == 3:
            own, logs, times = p
            score[own] += logs
            base[own] += logs
            known[own] += times
    ids = pa.array(docs, mask=null.astype(bool))
    return pa.table([ids, pa.array(held.astype(bool)), pa.array(lengths.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], schema=_SCORED)


def score_texts(docs: DataFrame, *, shape: Shape = Shape(), train_every: int = 1, train_lanes: int = 128, lanes: int = 256, rounds: int = 1, rate: float = 0.03, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    train_every: of the windows of a task's training texts, one in so many is
    back-propagated through (all by default); the state passes through all of them.
    """
    scratch = Scratch(docs.sparkSession, "language-model")
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    count = buckets or hash_buckets(splits(source), 64)
    sent = source.mapInArrow(_count(count), _DDL).groupBy("bucket")
    totals = scratch.keep(sent.applyInArrow(_total(shape.tails, max(64, -(-4 * shape.frequent // count))), _TOTALS_DDL), "counts")
    row = totals.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = row["tokens"] or 0, row["types"] or 0
    each = totals.select(F.explode(F.arrays_zip("top", "times")).alias("x")).select("x.top", "x.times").orderBy((F.col("top") != END).cast("int"), F.desc("times"), "top")
    top = [(bytes(r["top"]), r["times"]) for r in each.limit(shape.frequent).collect()]  # at most ``frequent`` rows
    mass = np.zeros(shape.tails)
    for r in totals.select(F.posexplode("tails").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():  # ``tails`` rows
        mass[r["k"]] = r["x"]
    words = Vocabulary.build(shape, top, mass, tokens, types)
    weights = initial(words, mass)
    for turn in range(rounds if tokens else 0):
        groups = 16
        fitted = source.mapInArrow(_fit(words, weights, train_every, train_lanes, rate / (1 + turn), groups), _WEIGHTS_DDL)
        means = fitted.groupBy("part").applyInArrow(_average, _WEIGHTS_DDL).collect()  # at most ``groups`` rows
        if means:
            weights = sum(r["seen"] * unpack(bytes(r["body"]))[0] for r in means) / sum(r["seen"] for r in means)
            weights = weights.astype(np.float32)
    scored = source.mapInArrow(_score(words, weights, count, lanes), _DDL)
    both = scored.unionByName(totals.select("bucket", F.lit(None).cast("long").alias("block"), "body"))
    looked = both.groupBy("bucket").applyInArrow(_look_up, _DDL)
    done = looked.groupBy("block").applyInArrow(_finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.withColumn("train_tokens", F.lit(tokens).cast("long"))


def initial(words: Vocabulary, mass: np.ndarray) -> np.ndarray:
    """Weights whose output biases are the logs of the class and word frequencies."""
    model, shape = Gated(words.shape), words.shape
    heads = min(shape.heads, words.base)
    number = np.full(shape.heads, 1e-3)
    number[:heads] = 10 ** words.logs[:heads] - 1 + 1e-3
    table = number.reshape(shape.classes, shape.words)
    model.bo[:] = np.log(table)
    model.bo[:] -= model.bo.max(axis=1, keepdims=True)
    weight = np.r_[table.sum(axis=1), 10**words.tail_log]
    model.bc[:] = np.log(weight / weight.sum())
    return model.flat


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
