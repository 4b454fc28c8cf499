"""Runs of offsets come as Arrow arrays, without a Python object each."""

import tracemalloc

import numpy as np

from latticework.llm import substrings


def test_runs_like_a_loop():
    rng = np.random.default_rng(4)
    best, most = rng.integers(0, 3, (200, 7)), rng.integers(0, 4, 200)
    want = {}
    for k, (row, top) in enumerate(zip(best.tolist(), most.tolist(), strict=True)):
        edge = [0, *(i for i in range(1, 7) if row[i] != row[i - 1]), 7]
        own = [{"low": a, "high": b - 1, "first_id": row[a]} for a, b in zip(edge, edge[1:], strict=False) if row[a] < top]
        want |= {k: own} if own else {}
    rows, runs = substrings._runs(best, most)
    assert dict(zip(rows.tolist(), runs.to_pylist(), strict=True)) == want


def test_runs_take_little_memory():
    best = np.arange(4000 * 35, dtype=np.int64).reshape(4000, 35)
    tracemalloc.start()
    substrings._runs(best, np.full(4000, substrings.NO_ID))
    assert tracemalloc.get_traced_memory()[1] < 10 << 20
    tracemalloc.stop()
