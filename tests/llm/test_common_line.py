"""Texts that share a line and nothing else make no pairs, however many they are."""

import random

import numpy as np
import pyarrow as pa

from latticework.llm import jaccard


def batches(sets, root):
    """Rows of the first shingle, which all sets share."""
    signs = [jaccard.signature(s) for s in sets]
    table = pa.table({"gram": pa.array([1] * len(sets)), "root": pa.array(root), "set": pa.array(range(len(sets))), "n": pa.array([len(s) for s in sets], pa.int32()), "sign": pa.array([x.tolist() for x in signs], pa.list_(pa.int64()))})
    return iter(table.to_batches(max_chunksize=70))


def test_a_common_line_makes_no_pairs():
    rng = np.random.default_rng(6)
    line = rng.integers(0, 2**63, 20).astype(np.uint64)
    sets = [np.concatenate([line, rng.integers(0, 2**63, 60).astype(np.uint64)]) for _ in range(300)]
    assert sum(map(len, jaccard._cross(0.8)(batches(sets, list(range(300)))))) == 0


def test_no_similar_pair_is_dropped():
    rng = random.Random(7)
    for n in (1, 5, 12, 90, 700, 3000):
        base = [rng.getrandbits(64) for _ in range(n)]
        sets = [np.array(base, np.uint64)]
        for _ in range(150):
            own = list(base)
            for _ in range(rng.randint(0, n // 6)):
                own[rng.randrange(len(own))] = rng.getrandbits(64)
            sets.append(np.array(own[rng.randint(0, n // 12) :], np.uint64))
        names = [set(s.tolist()) for s in sets]
        want = {(a, b) for b in range(151) for a in range(b) if len(names[a] & names[b]) >= 0.8 * len(names[a] | names[b])}
        got = {(r["a"], r["b"]) for x in jaccard._cross(0.8)(batches(sets, list(range(151)))) for r in x.to_pylist()}
        assert want and want <= got, n
