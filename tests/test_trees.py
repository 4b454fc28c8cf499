"""Extra trees and boosting against plain versions that hold the table in memory and grow one node at a time."""

import random

import numpy as np
import pytest

from latticework.operators import modeling, trees


def data(seed, n=240, width=5, classes=3):
    rng = random.Random(seed)
    x = np.array([[rng.choice([rng.uniform(-1, 1), rng.randint(0, 3)]) for _ in range(width)] for _ in range(n)], float)
    x[:, 3] = 7.0  # never varies
    y = np.array([int(a + 2 * b > 0.4) + int(c > 1) + rng.choice([0, 0, 0, 1]) for a, b, c in x[:, :3]]) % classes
    return x, y, np.array([1.0 + k % 3 for k in range(n)])


def table(spark, x, y, w):
    names = [f"f{k}" for k in range(x.shape[1])]
    return spark.createDataFrame([(*map(float, r), int(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], ", ".join(f"{c} double" for c in names) + ", y long, w double").repartition(5), names


def plain_extra_tree(x, y, w, t, seed, depth, least, classes, node=1, out=None):
    """{node: (feature, threshold)} and {node: class shares}."""
    out = out if out is not None else ({}, {})
    share = np.array([w[y == c].sum() for c in range(classes)])
    out[1][node] = share / share.sum()
    if depth == 0 or (share > 0).sum() < 2 or (node > 1 and len(y) < 2 * least):
        return out
    one = lambda v: np.array([v])
    draw = lambda s, f: trees.draws(s, one(t), one(node), one(f))[0]
    drawn = sorted(range(x.shape[1]), key=lambda f: draw(seed, f))[: int(x.shape[1] ** 0.5)]
    best = None
    for j, f in enumerate(drawn):
        low, high = x[:, f].min(), x[:, f].max()
        if low == high:
            continue
        at = low + (high - low) * draw(seed + 1, f)
        left = x[:, f] <= (at if at < high else low)
        if min(left.sum(), (~left).sum()) < least:
            continue
        pure = sum(sum(w[s & (y == c)].sum() ** 2 for c in range(classes)) / w[s].sum() for s in (left, ~left))
        if best is None or pure > best[0] + 1e-9:
            best = (pure, j, f, at if at < high else low, left)
    if best:
        _, _, f, at, left = best
        out[0][node] = (f, at)
        for side, child in ((left, 2 * node), (~left, 2 * node + 1)):
            plain_extra_tree(x[side], y[side], w[side], t, seed, depth - 1, least, classes, child, out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_extra_trees_equal_a_plain_version(spark, seed):
    x, y, w = data(seed)
    df, names = table(spark, x, y, w)
    model = trees.ExtraTrees(6, 5, seed).fit(df, names, "y", "w", 3)
    for t, tree in enumerate(model.trees):
        splits, shares = plain_extra_tree(x, y, w, t, seed, 5, 2, 3)
        assert {n: (f, at) for n, f, at in zip(tree.nodes.tolist(), tree.features.tolist(), tree.thresholds.tolist(), strict=True)} == splits
        assert tree.values.keys() == shares.keys() and all(np.allclose(tree.values[n], shares[n]) for n in shares)
    assert len(model.trees[0].nodes) > 3
    got = trees.with_probabilities(df, model, names, ["y"]).collect()
    assert all(sum(r.probabilities) == pytest.approx(1) for r in got)


def plain_boosting(x, y, w, edges, rounds, depth, rate, ridge, least, leaves, classes):
    s, gains, out = np.zeros((len(x), classes)), np.zeros(x.shape[1]), []
    for _ in range(rounds):
        e = np.exp(s - s.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        step = np.zeros_like(s)
        for c in range(classes):
            g, h = (p[:, c] - (y == c)) * w, p[:, c] * (1 - p[:, c]) * w
            score = lambda m, g=g, h=h: g[m].sum() ** 2 / (h[m].sum() + ridge)

            def best(m, g=g, h=h, score=score):
                found = (1e-12, None)
                for f in range(x.shape[1]):
                    for at in edges[f]:
                        left = m & (x[:, f] <= at)
                        right = m & ~left
                        if min(h[left].sum(), h[right].sum()) >= least and (gain := score(left) + score(right) - score(m)) > found[0] + 1e-9:
                            found = (gain, (f, at, left, right))
                return found

            open_ = [(*best(np.ones(len(x), bool)), 1, np.ones(len(x), bool))]
            closed = []
            while open_:
                open_.sort(key=lambda z: (-z[0], z[2]))
                gain, found, node, m = open_.pop(0)
                if found is None or node.bit_length() > depth or len(open_) + len(closed) + 1 >= leaves:
                    closed.append(m)
                    continue
                gains[found[0]] += gain
                out.append((node, found[0], found[1]))
                open_ += [(*best(found[2]), 2 * node, found[2]), (*best(found[3]), 2 * node + 1, found[3])]
            for m in closed:
                step[m, c] = -g[m].sum() / (h[m].sum() + ridge) * rate
        s += step
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True), gains, out


@pytest.mark.parametrize(("leaves", "depth"), [(None, 3), (4, 4)])
def test_boosting_equals_a_plain_version(spark, leaves, depth):
    x, y, w = data(4, n=150)
    df, names = table(spark, x, y, w)
    model = trees.Boosting(4, depth, 0.3, leaves, bins=8, fold=2).fit(df, names, "y", "w", 3)
    edges = [np.unique(np.quantile(x[:, f], [k / 8 for k in range(1, 8)])) for f in range(x.shape[1])]
    p, gains, splits = plain_boosting(x, y, w, edges, 4, depth, 0.3, 1.0, 1.0, leaves or 10**9, 3)
    own = [(n, f, at) for row in model.trees for t in row for n, f, at in zip(t.nodes.tolist(), t.features.tolist(), t.thresholds.tolist(), strict=True)]
    assert sorted((n, f, round(at, 9)) for n, f, at in own) == sorted((n, f, round(float(at), 9)) for n, f, at in splits)
    assert np.allclose(model.probabilities(x), p, atol=1e-9) and np.allclose(model.gains, gains)


def test_best_leaf_first():
    gains = {1: (9.0, 0, 0.0), 2: (1.0, 0, 0.0), 3: (5.0, 0, 0.0), 6: (8.0, 0, 0.0), 4: (7.0, 0, 0.0)}
    assert list(trees.best_first(gains, 4)) == [1, 3, 6] and list(trees.best_first(gains, 99)) == [1, 3, 6, 2, 4]


def test_importances_are_shares(spark):
    x, y, w = data(5, n=120)
    df, names = table(spark, x, y, w)
    from pyspark.sql import functions as F

    rows = modeling.gain_importances(df.withColumn("fold", F.col("w").cast("int")), names, "y", "fold", trees=2, depth=2).collect()
    assert len(rows) == 3 * 5 and all(r.importance == 0 for r in rows if r.feature == "f3")
    for k in {r.fold for r in rows}:
        assert sum(r.importance for r in rows if r.fold == k) == pytest.approx(1)
