"""Groups of few members are compared at once, with the pairs that members one after the other give."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from quarrylight.llm import jaccard_join as J


def _group(rng: np.random.Generator, members: int) -> pa.Table:
    base = rng.integers(0, 1 << 62, 700, dtype=np.uint64)
    low = int(rng.choice([20, 200, 480]))
    sets = [np.unique(np.r_[base[: rng.integers(low, 1.5 * low)], rng.integers(0, 1 << 62, rng.integers(0, 1 + low // 8), dtype=np.uint64)]) for _ in range(members)]
    own = [np.frombuffer(J.sketch(s), np.uint8) for s in sets]
    body = J.pack(rng.permutation(members).astype(np.int64) - 3, np.array([len(s) for s in sets], np.uint32), rng.choice([0, 1, 2, 3, 3, 3], members).astype(np.uint8), rng.integers(0, rng.choice([2, 4, members + 1]), members).astype(np.int64), np.array([len(x) for x in own], np.uint32), np.concatenate(own))
    return pa.table({"block": pa.array([0], pa.int32()), "blocks": pa.array([1], pa.int32()), "body": pa.array([body], pa.binary())})


@pytest.mark.parametrize("nearest", [4, 1, None])
def test_the_pairs_of_one_after_the_other(monkeypatch, nearest):
    rng, found = np.random.default_rng(7), 0
    for _ in range(60):
        table = _group(rng, int(rng.integers(2, 60)))
        pairs = J._across(75, 100, nearest)
        got = []
        for most, chunk in ((512, 1 << 22), (512, 200), (0, 1)):  # the last: one after the other
            monkeypatch.setattr(J, "AT_ONCE", most)
            monkeypatch.setattr(J, "BYTES", chunk)
            t = pairs((), table)
            got.append(sorted(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True)))
        assert got[0] == got[1] == got[2]
        found += len(got[0])
    assert found > 500


def test_few_calls_for_a_group(monkeypatch):
    met = []
    monkeypatch.setattr(J, "fold", lambda x, n, own=J.fold: met.append(n) or own(x, n))
    J._across(75, 100, None)((), _group(np.random.default_rng(1), 100))
    assert len(met) <= 9
