"""Exact Jaccard self-join of shingle sets by partitioning the universe (pigeonhole).

Two sets of sizes x <= y with Jaccard similarity of at least t differ in at most
H = (1 - t) / t * x elements. Sizes fall into bands so narrow that partners lie in one
band or in two that follow each other; a scheme serves one band (as the smaller
side) and the next. A scheme hashes elements into m segments. If the differences
that a pair may have cannot touch all of the segments a set has chosen, one chosen
segment agrees, so a signature of the segment's subset finds the pair:

* large sets choose H + 1 segments to agree exactly;
* small sets choose segments to agree up to one element, worth two of H + 1; their
  one-deletion neighbourhoods are indexed beside the subsets.

Which segments a set chooses is decided by cost: the fullest first, as the fewest
other sets share them, and empty ones, which many share, only if nothing else is
left. m is the smallest number at which that is next to impossible. Every segment is
indexed, so the choice needs no agreement between partners and loses no pair.

Sets that are equal are one node from the start. Signatures travel packed, once for
a node and task, and meet by hash. A bucket of few nodes yields its pairs; a large
one yields only pairs with one leader; after those are verified and joined into
components, the closest pairs between components as long as that joins more; and in
the end all pairs between the components that remain in it. Pairs whose parity
sketches show more differences than a link may have go without their sets being
read; all others are verified on the whole sets. Groups of thousands of near copies thus cost one pair for
each member.

Defined cases: null or blank texts have no shingles, link with nothing and are their
own component; null identifiers get null components of their own; repeated
identifiers count as copies if their sets are equal and are rows of their own; extra
columns are ignored. Elements are 64-bit hashes of shingles. Sets are named by 64 bits of
a 128-bit hash; the other 64 tell whether two sets share a name, in which case the join
starts again with other names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .blocks import Ragged
from .common import Scratch, column_bytes, documents, gathered, hash_buckets, lean, lean_group, pack, splits, squeeze, unpack, unsqueeze
from .components import components

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
#: Sets up to this size use one-deletion neighbourhoods. Buckets up to FEW nodes yield all pairs. A task takes so many members of a group against all.
SMALL, FEW, BLOCK = 64, 12, 4096
#: Groups of up to so many members are compared at once, so many bytes of sketches at a time.
AT_ONCE, BYTES = 512, 1 << 22


class Words(dict):
    """Hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    if len(x) < 2:
        return x
    first = np.empty(len(x), bool)
    first[0] = True
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def hashed_shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of shingles of words with the hashes ``h``; fewer words are one shingle."""
    if not len(h):
        return np.empty(0, np.uint64)
    n, size = max(1, len(h) - width + 1), min(len(h), width)
    out = h[:n] * _P
    for k in range(1, size):
        out += h[k : k + n]
        out *= _P
    return distinct(mix(out + np.uint64(size)))


def shingles(text: bytes, words: Words, width: int = 5) -> np.ndarray:
    found = text.lower().split()
    return hashed_shingles(np.fromiter(map(words.__getitem__, found), np.uint64, len(found)), width)


def block_shingles(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The shingles of each text, whose words are hashed once for the block."""
    own = blocks.Words(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, own.values.to_pylist()), np.uint64, len(own.values))
    flat, ends = hashes[own.index], np.cumsum(own.counts)
    for z, n in zip(ends.tolist(), own.counts.tolist(), strict=True):
        yield hashed_shingles(flat[z - n : z], width)


def _order(x: np.ndarray) -> np.ndarray:
    """A stable order of values that are not negative, by digits where they are small."""
    return np.argsort(x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x, kind="stable")


def set_id(elements: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """Name and check of a set."""
    h = xxhash.xxh128_intdigest(elements.tobytes(), salt)
    return (h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


class Schemes:
    """Size bands, and for each the number of segments, for similarity num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1, 2]
        self.known: dict[int, tuple[int, bool]] = {}
        self.salts: dict[int, np.ndarray] = {}

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, (self.starts[-1] - 1) * self.den // self.num + 1))
        lo, hi = 0, len(self.starts) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= n else (lo, mid)
        return lo

    def differences(self, n: int) -> int:
        return n * (self.den - self.num) // self.num

    def segments(self, scheme: int) -> tuple[int, bool]:
        """(m, whether one-deletion neighbourhoods are used)."""
        if scheme not in self.known:
            self.known[scheme] = self._segments(scheme)
        return self.known[scheme]

    def _segments(self, scheme: int) -> tuple[int, bool]:
        while len(self.starts) <= scheme + 1:
            self.band(self.starts[-1])
        n = self.starts[scheme + 1] - 1
        need = self.differences(n) + 1
        if need == 1:
            return 1, False
        if n <= SMALL:
            return -(-need // 2), True
        m = need
        while True:
            r = math.exp(-n / m)
            mean, spread = m * (1 - r), math.sqrt(max(m * r * (1 - (1 + n / m) * r), 0.01))
            if mean - 6 * spread >= need:
                return m, False
            m += max(1, m // 100)

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and flags: 2 for a whole segment, 1 for one the set has chosen."""
        n = len(s)
        band = self.band(n)
        keys, flags = [], []
        element, where = mix(s * _P + np.uint64(1)), mix(s ^ _P)
        for scheme, smaller in ((band, True), (band - 1, False)):
            if scheme < 0:
                continue
            m, deletions = self.segments(scheme)
            seg = (where >> np.uint64(11)) % np.uint64(m)
            order = _order(seg)
            seg, own = seg[order].astype(np.int64), element[order]
            size = np.bincount(seg, minlength=m)
            total = np.zeros(m, np.uint64)
            full = np.flatnonzero(size)
            total[full] = np.add.reduceat(own, (np.cumsum(size) - size)[full])
            if scheme not in self.salts:
                self.salts[scheme] = (np.arange(m, dtype=np.uint64) + np.uint64(1)) * _P + np.uint64((scheme + 1) * int(_Q) % 2**64)
            salt = self.salts[scheme]
            flag = np.full(m, 2, np.uint8)
            chosen = np.zeros(m, bool)
            if smaller:
                need = self.differences(n) + 1
                best = _order(size.max() - size)
                chosen[best[: -(-need // 2) if deletions else need]] = True
                flag[chosen] |= 1
            keys.append(mix(total + salt))
            flags.append(flag)
            if deletions:
                keys.append(mix(total[seg] - own + salt[seg]))
                flags.append(chosen[seg].astype(np.uint8))
        return np.concatenate(keys), np.concatenate(flags)


_MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
_MESSAGE_DDL = "bucket int, kind int, body binary"
_SIGNS, _ROWS, _PAIRS, _GROUP = range(4)


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many elements hash to each of a power of two of cells, at least twice as many as there are elements.

    Sketches fold to half their cells by exclusive or, and two sets differ in at least as many elements as their parities do.
    """
    cells = max(64, 2 << (len(s) - 1).bit_length())
    count = np.bincount((mix(s + _Q) >> np.uint64(13)).astype(np.int64) & (cells - 1), minlength=cells)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def fold(parities: np.ndarray, size: int) -> np.ndarray:
    """Rows of sketches, folded to ``size`` bytes."""
    while parities.shape[-1] > size:
        half = parities.shape[-1] // 2
        parities = parities[..., :half] ^ parities[..., half:]
    return parities


def apart(parity: np.ndarray, parities: np.ndarray) -> np.ndarray:
    """Least differences between a set and others, whose parities all have the same length."""
    size = min(len(parity), parities.shape[1])
    return np.bitwise_count(fold(parity, size) ^ fold(parities, size)).sum(axis=1, dtype=np.int64)


def may_link(n: int, parity: np.ndarray, sizes: np.ndarray, parities: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of some sets may be as similar to one of n elements as asked."""
    return apart(parity, parities) * (den + num) <= (den - num) * (sizes.astype(np.int64) + n)


def _sign(num: int, den: int, width: int, buckets: int, salt: int, limit: int = 1_000_000):
    """Packed signatures for each bucket, and packed rows of documents."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes = Schemes(num, den)
        seen: set[int] = set()
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        size = turn = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            key, flag = (np.concatenate([h[i] for h in held]) for i in (2, 3))
            owner = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            nodes, sizes = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.uint32)
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = _order(bucket)
            key, flag, owner, bucket = key[order], flag[order], owner[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            at, bodies = [], []
            for k in range(buckets):
                a, z = edges[k], edges[k + 1]
                if a < z:
                    own, count = np.unique(owner[a:z], return_counts=True)
                    high = key[a:z] >> np.uint64(20)
                    at.append(k)
                    bodies.append(pack(nodes[own], sizes[own], count.astype(np.uint32), high.astype(np.uint32), ((high >> np.uint64(32)).astype(np.uint8) & 63) << 2 | flag[a:z]))
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([_SIGNS] * len(at), pa.int32()), pa.array(bodies, pa.binary())], schema=_MESSAGE)

        for b, texts in blocks.blocks(batches, blocks.BLOCK // 2):
            ids, counts, sets, sketches = b.column("doc_id").to_pylist(), [], [], []
            for s in block_shingles(texts, width):
                node, check = set_id(s, salt) if len(s) else (0, 0)
                counts.append(len(s))
                sets.append((node, check))
                sketches.append(b"")
                if len(s) and node not in seen:
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(node)
                    sketches[-1] = sketch(s)
                    held.append((node, len(s), *schemes.signatures(s)))
                    size += len(held[-1][2])
                    if size >= limit:
                        yield flush()
            if ids:
                turn += 1
                to = xxhash.xxh32_intdigest(f"{ids[0]} {counts[0]} {turn}") % buckets
                both = np.array(sets, np.int64)
                body = pack(np.array([i is None for i in ids], np.uint8), np.array([i or 0 for i in ids], np.int64), np.array(counts, np.int64), both[:, 0], both[:, 1], np.fromiter(map(len, sketches), np.uint32, len(ids)), np.frombuffer(b"".join(sketches), np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([_ROWS], pa.int32()), pa.array([body], pa.binary())], schema=_MESSAGE)
        if held:
            yield flush()

    return make


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for body in b.column("body").to_pylist():
            null, ids, counts, nodes, checks = unpack(body)[:5]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(counts), pa.array(nodes, mask=counts == 0), pa.array(checks, mask=counts == 0)], names=["doc_id", "n_shingles", "node", "check"])


def _open_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for body in b.column("body").to_pylist():
            _, _, counts, nodes, _, lengths, raw = unpack(body)
            own, ends = np.flatnonzero(lengths), np.cumsum(lengths.astype(np.int64))
            flat = raw.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(counts[own]), pa.array([flat[ends[i] - lengths[i] : ends[i]] for i in own.tolist()], pa.binary())], names=["node", "size", "sketch"])


_FOUND = pa.schema([("kind", pa.int32()), ("group", pa.int64()), ("body", pa.binary())])
_FOUND_DDL = "kind int, group long, body binary"


def _partners(size_a: np.ndarray, size_b: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * np.minimum(size_a, size_b) >= num * np.maximum(size_a, size_b)


def _meet(num: int, den: int):
    """Pairs of a bucket and its large groups; rows of documents pass."""

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        kinds, own = table.column("kind").to_pylist(), table.column("body").to_pylist()
        passed = [x for k, x in zip(kinds, own, strict=True) if k == _ROWS]
        parts = [unpack(x) for k, x in zip(kinds, own, strict=True) if k == _SIGNS] or [[np.zeros(0, t) for t in (np.int64, np.uint32, np.uint32, np.uint32, np.uint8)]]
        node, size = (np.concatenate([np.repeat(p[i], p[2]) for p in parts]) for i in (0, 1))
        low, high = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
        sig, flag = low.astype(np.uint64) | (high >> 2).astype(np.uint64) << np.uint64(32), high & 3
        order = np.argsort(sig, kind="stable")
        again = np.r_[False, sig[order][1:] == sig[order][:-1]][: len(sig)]
        order = order[again | np.r_[again[1:], False][: len(sig)]]  # signatures that occur twice at least
        sig, node, size, flag = sig[order], node[order], size[order].astype(np.int64), flag[order]
        order = np.lexsort((node, sig))
        sig, node, size, flag = sig[order], node[order], size[order], flag[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])] if len(sig) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        if len(start):
            flag = np.bitwise_or.reduceat(flag, start)
            sig, node, size = sig[start], node[start], size[start]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(sig)])
        lefts, rights, groups, bodies = [], [], [], []
        for k in range(2, FEW + 1):
            at = first[count == k]
            for i in range(k):
                for j in range(i + 1, k):
                    a, b = at + i, at + j
                    ok = ((flag[a] | flag[b]) == 3) & _partners(size[a], size[b], num, den)
                    lefts.append(node[a[ok]])
                    rights.append(node[b[ok]])
        for at, k in zip(first[count > FEW].tolist(), count[count > FEW].tolist(), strict=True):
            own = np.arange(at, at + k)
            whole = own[(flag[own] & 2) > 0]
            if not len(whole) or not (flag[own] & 1).any():
                continue
            whole = whole[flag[whole] == flag[whole].max()]
            lead = whole[np.argsort(size[whole], kind="stable")[len(whole) // 2]]
            rest = own[own != lead]
            ok = rest[_partners(size[rest], size[lead], num, den) & ((flag[rest] | flag[lead]) == 3)]
            lefts.append(np.minimum(node[ok], node[lead]))
            rights.append(np.maximum(node[ok], node[lead]))
            groups.append(int(sig[at].astype(np.int64)) << 18 | int(key[0].as_py()))
            bodies.append(pack(node[own], size[own], flag[own]))
        pairs = np.column_stack([np.concatenate(lefts), np.concatenate(rights)]) if lefts else np.zeros((0, 2), np.int64)
        if len(pairs):
            pairs = np.unique(np.ascontiguousarray(pairs).view([("a", np.int64), ("b", np.int64)])).view(np.int64).reshape(-1, 2)
        kinds = [_GROUP] * len(groups) + [_PAIRS] + [_ROWS] * len(passed)
        bodies += [pack(pairs[:, 0], pairs[:, 1]), *passed]
        groups += [None] * (1 + len(passed))
        return pa.table([pa.array(kinds, pa.int32()), pa.array(groups, pa.int64()), pa.array(bodies, pa.binary())], schema=_FOUND)

    return meet


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for body in b.column("body").to_pylist():
            x, y = unpack(body)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


_ASKED = pa.schema([("part", pa.int32()), ("group", pa.int64()), ("blocks", pa.int32()), ("body", pa.binary())])
_ASKED_DDL = "part int, group long, blocks int, body binary"
_TOLD = pa.schema([("group", pa.int64()), ("blocks", pa.int32()), ("body", pa.binary())])
_TOLD_DDL = "group long, blocks int, body binary"


def _dealt(node: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Places of nodes, by the part of each."""
    own = ((node.astype(np.uint64) * _Q) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(own, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0, True]) if len(own) else [0]
    return [(int(own[order[a]]), order[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def _ask(parts: int):
    """Members of groups, packed, to the parts that know their nodes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, body in zip(b.column("group").to_pylist(), b.column("body").to_pylist(), strict=True):
                node, size, flag = unpack(body)
                sent = [(k, pack(node[i], size[i], flag[i])) for k, i in _dealt(node, parts)]
                blocks = -(-len(node) // BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sent], pa.int32()), pa.array([group] * len(sent), pa.int64()), pa.array([blocks] * len(sent), pa.int32()), pa.array([x for _, x in sent], pa.binary())], schema=_ASKED)

    return make


def _tell(parts: int):
    """Roots and sketches of nodes, packed, to their parts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, root = (b.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root"))
            sketches = b.column("sketch").to_pylist()
            sent = [(k, pack(node[i], root[i], *_ragged([sketches[j] for j in i.tolist()]))) for k, i in _dealt(node, parts)]
            none = pa.nulls(len(sent), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sent], pa.int32()), none, pa.array([0] * len(sent), pa.int32()), pa.array([x for _, x in sent], pa.binary())], schema=_ASKED)

    return make


def _ragged(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(map(len, values), np.uint32, len(values)), np.frombuffer(b"".join(values), np.uint8)


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Members with their roots and sketches, on the way to their groups."""
    groups, blocks, bodies = (table.column(c).to_pylist() for c in ("group", "blocks", "body"))
    known = [unpack(x) for g, x in zip(groups, bodies, strict=True) if g is None]
    asked = [(g, n, x) for g, n, x in zip(groups, blocks, bodies, strict=True) if g is not None]
    if not known or not asked:
        return _TOLD.empty_table()
    node, root = (np.concatenate([k[i] for k in known]) for i in (0, 1))
    sketches = Ragged(np.concatenate([k[3] for k in known]), np.concatenate([k[2] for k in known]))
    order = np.argsort(node, kind="stable")
    out = []
    for _, _, body in asked:
        own, size, flag = unpack(body)
        at = order[np.searchsorted(node, own, sorter=order)]
        mine = sketches.take(at)
        out.append(pack(own, size, flag, root[at], mine.lengths.astype(np.uint32), mine.flat))
    return pa.table([pa.array([g for g, _, _ in asked], pa.int64()), pa.array([n for _, n, _ in asked], pa.int32()), pa.array(out, pa.binary())], schema=_TOLD)


def _together(size: np.ndarray, flag: np.ndarray, root: np.ndarray, sketches: Ragged, main: int | None, num: int, den: int, nearest: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of both ends of the pairs of ``_across``, for all members of a group, which are in the order of their sizes."""
    ok = (root[:, None] != root) & ((flag[:, None] | flag) == 3) & (num * size <= den * size[:, None])
    if nearest:
        ok &= (root != main) | (root[:, None] != main)
    i, j = np.nonzero(np.triu(ok, 1))
    least, best = np.minimum(sketches.lengths[i], sketches.lengths[j]), np.empty(len(i), np.int64)
    for n in np.unique(least).tolist():
        stack, own = np.zeros((len(size), n), np.uint8), np.flatnonzero(least == n)
        for m in np.unique(sketches.lengths[sketches.lengths >= n]).tolist():
            at = np.flatnonzero(sketches.lengths == m)
            stack[at] = fold(sketches.take(at).flat.reshape(-1, m), n)
        words = stack.view(np.uint64)  # sketches have 64 cells at least
        step = max(1, BYTES // n)
        for a in range(0, len(own), step):
            some = own[a : a + step]
            best[some] = np.bitwise_count(words[i[some]] ^ words[j[some]]).sum(axis=1, dtype=np.int64)
    near = best * (den + num) <= (den - num) * (size[i] + size[j])
    i, j, best = i[near], j[near], best[near]
    if nearest:  # of each member outside the largest component, the closest partners
        i, j, best = np.r_[i, j], np.r_[j, i], np.r_[best, best]
        order = np.lexsort((j, best, i))
        i, j = i[order], j[order]
        keep = (np.arange(len(i)) - np.searchsorted(i, i) < nearest) & (root[i] != main)
        i, j = i[keep], j[keep]
    return i, j


def _across(num: int, den: int, nearest: int | None):
    """Pairs of a group between components that sizes and sketches allow, for one block of its members against all.

    nearest: if given, only so many for each member, those that seem closest, and none
    for members of the group's largest component.
    """

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        block, of = table.column("block")[0].as_py(), table.column("blocks")[0].as_py()
        parts = [unpack(x) for x in table.column("body").to_pylist()]
        node, size, flag, root, lengths = (np.concatenate([p[i] for p in parts]) for i in range(5))
        names, count = np.unique(root, return_counts=True)
        if len(names) == 1:
            return pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
        order = np.lexsort((node, size))
        sketches = Ragged(np.concatenate([p[5] for p in parts]), lengths).take(order)
        node, size, flag, root, lengths = node[order], size[order].astype(np.int64), flag[order], root[order], sketches.lengths
        main = names[count.argmax()] if nearest else None
        if of == 1 and len(node) <= AT_ONCE:
            i, j = _together(size, flag, root, sketches, main, num, den, nearest)
            return pa.table([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])
        rows, stacks = np.zeros(len(node), np.int64), {}
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            rows[own] = np.arange(len(own))
            stacks[n] = sketches.take(own).flat.reshape(-1, n)
        lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(block, len(node), of):
            if nearest and root[i] == main:
                continue
            near = np.searchsorted(size, -(-size[i] * num // den)) if nearest else i + 1
            j = np.arange(near, np.searchsorted(size, size[i] * den // num, side="right"))
            j = j[(root[j] != root[i]) & ((flag[j] | flag[i]) == 3)]
            if not len(j):
                continue
            mine = stacks[int(lengths[i])][rows[i]]
            if lengths[j[0]] == lengths[j[-1]]:  # lengths follow sizes, in whose order the members are
                best = apart(mine, stacks[int(lengths[j[0]])][rows[j]])
            else:
                best = np.empty(len(j), np.int64)
                for n in np.unique(lengths[j]).tolist():
                    own = lengths[j] == n
                    best[own] = apart(mine, stacks[n][rows[j[own]]])
            ok = best * (den + num) <= (den - num) * (size[j] + size[i])
            j, best = j[ok], best[ok]
            if nearest:
                j = j[np.argsort(best, kind="stable")[:nearest]]
            lefts.append(np.minimum(node[j], node[i]))
            rights.append(np.maximum(node[j], node[i]))
        return pa.table([pa.array(np.concatenate(lefts)), pa.array(np.concatenate(rights))], names=["a", "b"])

    return pairs


def _plausible(num: int, den: int):
    """Pairs whose sketches allow a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(c).to_numpy() for c in ("size_a", "size_b"))
            x, y = ([np.frombuffer(v, np.uint8) for v in b.column(c).to_pylist()] for c in ("sketch_a", "sketch_b"))
            ok = [bool(may_link(int(n[i]), x[i], m[i : i + 1], y[i][None, :], num, den)[0]) for i in range(b.num_rows)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return keep


def _squeezed(width: int, salt: int):
    """Texts of nodes; of rows that share an identifier only those with the node's set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            own = [(n, squeeze(x)) for n, x in zip(b.column("node").to_pylist(), column_bytes(b, "text"), strict=True) if set_id(shingles(x, words, width), salt)[0] == n]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.int64()), pa.array([x for _, x in own], pa.binary())], names=["node", "body"])

    return make


def _verify(num: int, den: int, width: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, mine = Words(), None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            kept = []
            for i, (x, y) in enumerate(zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)):
                if b[i] != last:
                    last, mine = b[i], shingles(unsqueeze(y), words, width)
                if similar(shingles(unsqueeze(x), words, width), mine, num, den):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in kept], pa.int64()), pa.array([b[i] for i in kept], pa.int64())], names=["a", "b"])

    return check


def jaccard_components(docs: DataFrame, *, num: int = 75, den: int = 100, width: int = 5, buckets: int | None = None) -> DataFrame:
    """One row for a document: doc_id, n_shingles, component_id.

    Links are pairs of shingle sets with den * intersection >= num * union; a component
    is all that links reach, named by its smallest doc_id.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    count, salt = buckets or hash_buckets(splits(source), 64), 0
    while True:
        signed = source.mapInArrow(lean(_sign(num, den, width, count, salt)), _MESSAGE_DDL)
        found = scratch.keep(signed.groupBy("bucket").applyInArrow(lean_group(_meet(num, den)), _FOUND_DDL), "found")
        packed = found.where(F.col("kind") == _ROWS).select("body")
        rows = packed.mapInArrow(lean(_open_rows), "doc_id long, n_shingles long, node long, check long")
        named = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("lo"), F.max("check").alias("hi"))
        reps = scratch.keep(named, "sets")
        if reps.where("lo <> hi").isEmpty():
            break
        salt += 1  # two sets of one name, told apart by their checks: all get other names
    reps = reps.select("node", "doc_id")
    # tasks that hold a set each send its sketch; one row for a set, so that joins multiply nothing
    sketches = scratch.keep(packed.mapInArrow(lean(_open_sketches), "node long, size long, sketch binary").dropDuplicates(["node"]), "sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        n = pairs.count()
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(reps, "node")
        owned = source.join(wanted, "doc_id").select("node", "text").mapInArrow(lean(_squeezed(width, salt)), "node long, body binary")
        bodies = scratch.keep(gathered(owned.dropDuplicates(["node"]), 2 * n, 8000), "bodies")
        left = pairs.join(bodies.withColumnRenamed("node", "a").withColumnRenamed("body", "left"), "a")
        both = left.join(bodies.withColumnRenamed("node", "b").withColumnRenamed("body", "right"), "b")
        kept = scratch.keep(gathered(both.select("a", "b", "left", "right").mapInArrow(lean(_verify(num, den, width)), "a long, b long"), n, 2000), "links")
        scratch.drop(bodies)
        scratch.drop(pairs)
        return kept

    pairs = found.where(F.col("kind") == _PAIRS).select("body").mapInArrow(lean(_open_pairs), "a long, b long").distinct()
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    links = verified(scratch.keep(pairs.mapInArrow(lean(_plausible(num, den)), "a long, b long").distinct(), "pairs"))
    roots = components(links, scratch)
    groups = found.where(F.col("kind") == _GROUP).select("group", "body")
    nearest: int | None = 4
    left, parts = not groups.isEmpty(), max(8, count // 16)  # members of a group that ask the same part go in one message
    while left:  # closest pairs between components as long as they link, then all that are left
        nodes = sketches.select("node", "sketch").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "sketch")
        asked = groups.mapInArrow(lean(_ask(parts)), _ASKED_DDL).unionByName(nodes.mapInArrow(lean(_tell(parts)), _ASKED_DDL))
        told = asked.groupBy("part").applyInArrow(lean_group(_answer), _TOLD_DDL).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        more = told.groupBy("group", "block").applyInArrow(lean_group(_across(num, den, nearest)), "a long, b long").distinct()
        new = verified(scratch.keep(more, "pairs"))
        fresh = not new.isEmpty()
        if fresh:
            links = links.union(new)
            roots = components(links, scratch)
        left, nearest = nearest is not None, nearest if fresh else None
    owned = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = owned.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = owned.join(least, "root", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
