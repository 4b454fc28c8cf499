"""Extremely randomised trees and softmax boosting, grown level by level over the whole table.

All trees (extra trees) or all classes' trees of a round (boosting) grow together: a task finds its rows' nodes from the splits so far and
adds up what the open nodes need, one row per node, feature and side or bin; Spark sums these and picks each node's best split.  No group
of rows meets in a task, and what a task sends doesn't grow with its rows.  The splits are the model: they are bounded by trees and depth,
and more than MAX_CELLS numbers for a level are an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import cut, wide_quantiles

#: Numbers that a task holds for the open nodes of a level: 400 MB.
MAX_CELLS = 50_000_000
#: Rows that one task of boosting adds up, at least, before there are more tasks.
TASK_ROWS = 1 << 14


@dataclass
class Tree:
    """Splits by node (the root is 1, the children of n are 2n and 2n + 1): rows of at most the threshold go left."""

    nodes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: dict[int, np.ndarray] = field(default_factory=dict)

    def split(self, nodes: list[int], features: list[int], thresholds: list[float]) -> None:
        n, f, t = (np.concatenate(x) for x in ((self.nodes, np.array(nodes, np.int64)), (self.features, np.array(features, np.int64)), (self.thresholds, np.array(thresholds, float))))
        order = np.argsort(n)
        self.nodes, self.features, self.thresholds = n[order], f[order], t[order]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The last node of each row."""
        node = np.ones(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows) and len(self.nodes):
            at = np.minimum(np.searchsorted(self.nodes, node[rows]), len(self.nodes) - 1)
            hit = self.nodes[at] == node[rows]
            rows, at = rows[hit], at[hit]
            node[rows] = 2 * node[rows] + (x[rows, self.features[at]] > self.thresholds[at])
        return node

    def leaf_values(self, x: np.ndarray) -> np.ndarray:
        names = np.array(sorted(self.values))
        table = np.stack([self.values[n] for n in names.tolist()])
        return table[np.searchsorted(names, self.route(x))]


def draws(seed: int, tree: np.ndarray, node: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on all four alone (a 64-bit finaliser over their weighted sum)."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + tree.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + node.astype(np.uint64) * np.uint64(0xAF251AF3B0F025B5) + feature.astype(np.uint64) * np.uint64(0xF1357AEA2E62A9C5)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) / 2.0**53


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features (rows by columns), label numbers and weights of each batch."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)


def _emit(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _ready(df: DataFrame, features: list[str], label: str, weight: str) -> DataFrame:
    return df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("long").alias("y"), F.col(weight).cast("double").alias("w"))


class ExtraTrees:
    """Trees whose thresholds are drawn, not searched: of about sqrt(features) drawn features, each with one threshold between the least and the
    largest value in the node, the one that lowers the weighted Gini impurity most splits it.

    A leaf has ``min_leaf`` rows or more; of equal splits the feature drawn first is taken; a node in which no drawn feature varies is a leaf.
    """

    def __init__(self, trees: int, depth: int, seed: int, min_leaf: int = 2) -> None:
        self.trees, self.depth, self.seed, self.min_leaf = [Tree() for _ in range(trees)], depth, seed, min_leaf

    def fit(self, df: DataFrame, features: list[str], label: str, weight: str, classes: int) -> ExtraTrees:
        rows = cut(_ready(df, features, label, weight))
        k = max(1, math.isqrt(len(features)))
        total = np.zeros(classes)
        for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect():
            total[r["y"]] = r["w"]
        for t in self.trees:
            t.values[1] = total / total.sum()
        open_ = np.array([(t, 1) for t in range(len(self.trees))], np.int64)
        for _ in range(self.depth):
            if not len(open_) or (total > 0).sum() < 2:
                break
            if len(open_) * k * 2 * classes > MAX_CELLS:
                raise ValueError("too many open nodes: use fewer trees or less depth")
            tree, node = (np.repeat(open_[:, c, None], len(features), axis=1) for c in (0, 1))
            order = np.argsort(draws(self.seed, tree, node, np.broadcast_to(np.arange(len(features)), tree.shape)), axis=1, kind="stable")[:, :k]
            low, high = self._ranges(rows, open_, order)
            u = draws(self.seed + 1, np.repeat(open_[:, :1], k, 1), np.repeat(open_[:, 1:], k, 1), order)
            cut_at = low + (high - low) * u
            cut_at = np.where(cut_at < high, cut_at, low)
            open_ = self._split(rows, open_, order, cut_at, low < high, classes)
        return self

    def _ranges(self, rows: DataFrame, open_: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        trees, k = self.trees, order.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.full(order.shape, np.inf), np.full(order.shape, -np.inf)
            for x, _, _ in _blocks(batches):
                for rows_, at in _open_rows(trees, x, open_):
                    for j in range(k):
                        v = x[rows_, order[at, j]]
                        np.minimum.at(low[:, j], at, v)
                        np.maximum.at(high[:, j], at, v)
            i, j = np.nonzero(low <= high)
            yield _emit(["i", "j", "low", "high"], [i, j, low[i, j], high[i, j]])

        low, high = np.full(order.shape, np.inf), np.full(order.shape, -np.inf)
        for r in rows.mapInArrow(run, "i long, j long, low double, high double").groupBy("i", "j").agg(F.min("low"), F.max("high")).collect():
            low[r[0], r[1]], high[r[0], r[1]] = r[2], r[3]
        return low, high

    def _split(self, rows: DataFrame, open_: np.ndarray, order: np.ndarray, cut_at: np.ndarray, varies: np.ndarray, classes: int) -> np.ndarray:
        trees, k, least = self.trees, order.shape[1], self.min_leaf

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape = (*order.shape, 2, classes)
            weight, count = np.zeros(math.prod(shape)), np.zeros(math.prod(shape), np.int64)
            for x, y, w in _blocks(batches):
                for rows_, at in _open_rows(trees, x, open_):
                    for j in range(k):
                        right = (x[rows_, order[at, j]] > cut_at[at, j]).astype(np.int64)
                        cell = ((at * k + j) * 2 + right) * classes + y[rows_]
                        np.add.at(weight, cell, w[rows_])
                        np.add.at(count, cell, 1)
            cell = np.flatnonzero(count)
            i, j, side, y = np.unravel_index(cell, shape)
            keep = varies[i, j]
            yield _emit(["i", "j", "side", "y", "w", "n"], [c[keep] for c in (i, j, side, y, weight[cell], count[cell])])

        sums = rows.mapInArrow(run, "i long, j long, side long, y long, w double, n long").groupBy("i", "j", "side", "y").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        sides = sums.groupBy("i", "j", "side").agg((F.sum(F.col("w") * F.col("w")) / F.sum("w")).alias("pure"), F.sum("n").alias("n"), F.collect_list(F.struct("y", "w")).alias("counts"))
        both = sides.groupBy("i", "j").agg(F.sum("pure").alias("pure"), F.min("n").alias("least"), F.count(F.lit(1)).alias("sides"), F.collect_list(F.struct("side", "n", "counts")).alias("parts")).filter((F.col("sides") == 2) & (F.col("least") >= least))
        best = both.groupBy("i").agg(F.max_by(F.struct("j", "parts"), F.struct("pure", -F.col("j"))).alias("m")).collect()
        ahead = []
        found: dict[int, list[tuple[int, int, float]]] = {}
        for r in best:
            (t, node), j = open_[r["i"]].tolist(), r["m"]["j"]
            found.setdefault(t, []).append((node, int(order[r["i"], j]), float(cut_at[r["i"], j])))
            for part in r["m"]["parts"]:
                share = np.zeros(classes)
                for c in part["counts"]:
                    share[c["y"]] = c["w"]
                child = 2 * node + part["side"]
                trees[t].values[child] = share / share.sum()
                if (share > 0).sum() > 1 and part["n"] >= 2 * least:
                    ahead.append((t, child))
        for t, splits in found.items():
            trees[t].split(*map(list, zip(*splits, strict=True)))
        return np.array(sorted(ahead), np.int64).reshape(-1, 2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sum(t.leaf_values(x) for t in self.trees) / len(self.trees)


def _open_rows(trees: list[Tree], x: np.ndarray, open_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each tree with open nodes: the rows in them, and the nodes' places in ``open_`` (sorted by tree and node)."""
    for t in np.unique(open_[:, 0]).tolist():
        first, last = np.searchsorted(open_[:, 0], [t, t + 1])
        mine = open_[first:last, 1]
        node = trees[t].route(x)
        at = np.minimum(np.searchsorted(mine, node), len(mine) - 1)
        rows = np.flatnonzero(mine[at] == node)
        yield rows, first + at[rows]


class Boosting:
    """Softmax boosting over histograms: a round has a tree per class, grown on gradients p - y and second derivatives p (1 - p).

    A split's gain is GL²/(HL+λ) + GR²/(HR+λ) - G²/(H+λ); a leaf is worth -G/(H+λ) times the rate.  Trees grow a level at a time to ``depth``;
    with ``leaves``, only the splits that growing the best leaf first would make are kept, which is the same tree as growing it one by one.
    ``gains`` sums the gains per feature.
    """

    def __init__(self, rounds: int, depth: int, rate: float = 0.1, leaves: int | None = None, bins: int = 64, ridge: float = 1.0, min_weight: float = 1.0, fold: int = 8) -> None:
        self.rounds, self.depth, self.rate, self.leaves, self.bins, self.ridge, self.min_weight, self.fold = rounds, depth, rate, leaves, bins, ridge, min_weight, fold
        self.trees: list[list[Tree]] = []
        self.gains = np.zeros(0)

    def fit(self, df: DataFrame, features: list[str], label: str, weight: str, classes: int) -> Boosting:
        q = wide_quantiles(df, features, [], [k / self.bins for k in range(1, self.bins)]).first()
        edges = [np.unique([v for v in (q[f"q_{c}"] or []) if v is not None]) for c in features]
        state = cut(_ready(df, features, label, weight).withColumn("s", F.array_repeat(F.lit(0.0), classes)))
        # Every level is a job over all tasks, so few rows make few tasks.
        wanted = state.count() // TASK_ROWS + 1
        state = cut(state.coalesce(wanted)) if wanted < state.rdd.getNumPartitions() else state
        self.gains = np.zeros(len(features))
        done = 0
        for k in range(self.rounds):
            fresh = self.trees[done:]
            self.trees.append(self._round(state, fresh, edges, classes))
            if len(self.trees) - done == self.fold and k < self.rounds - 1:
                state, done = cut(state.mapInArrow(_scoring(self.trees[done:]), state.schema)), len(self.trees)
        return self

    def _round(self, state: DataFrame, fresh: list[list[Tree]], edges: list[np.ndarray], classes: int) -> list[Tree]:
        made, n_bins, width = [Tree() for _ in range(classes)], max(map(len, edges)) + 1, len(edges)
        open_ = np.array([(c, 1) for c in range(classes)], np.int64)
        gain: dict[tuple[int, int], tuple[float, int, float]] = {}
        for level in range(self.depth):
            if not len(open_):
                break
            if len(open_) * width * n_bins * 2 > MAX_CELLS:
                raise ValueError("too many open nodes: use less depth or fewer bins")
            # A task gives a row per node, feature and bin, so one exchange by node is enough for all sums.
            hist = state.mapInArrow(_histograms(fresh, made, open_, edges, n_bins, classes), "i long, f long, b long, g double, h double").repartition("i").groupBy("i", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            ahead = []
            for r in _best_splits(hist, self.ridge, self.min_weight).collect():
                (c, node), f = open_[r["i"]].tolist(), r["f"]
                if level == 0:
                    self._worth(made, (c, node), r["g"], r["h"])
                if r["b"] < 0:
                    continue
                gain[c, node] = (r["gain"], f, float(edges[f][r["b"]]))
                made[c].split([node], [f], [float(edges[f][r["b"]])])
                self._worth(made, (c, 2 * node), r["gl"], r["hl"])
                self._worth(made, (c, 2 * node + 1), r["g"] - r["gl"], r["h"] - r["hl"])
                ahead += [(c, 2 * node), (c, 2 * node + 1)]
            open_ = np.array(sorted(ahead), np.int64).reshape(-1, 2)
        for c, tree in enumerate(made):
            kept = {n: v for (k, n), v in gain.items() if k == c}
            kept = best_first(kept, self.leaves) if self.leaves else kept
            pruned = Tree(values=tree.values)
            pruned.split(list(kept), [v[1] for v in kept.values()], [v[2] for v in kept.values()])
            made[c] = pruned
            for value, f, _ in kept.values():
                self.gains[f] += value
        return made

    def _worth(self, made: list[Tree], at: tuple[int, int], g: float, h: float) -> None:
        made[int(at[0])].values[int(at[1])] = np.array([-g / (h + self.ridge) * self.rate])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(scores(self.trees, x, np.zeros((len(x), len(self.trees[0])))))


def best_first(gains: dict[int, tuple[float, int, float]], leaves: int) -> dict[int, tuple[float, int, float]]:
    """The splits that growing the leaf of the highest gain first makes, until there are ``leaves``."""
    kept: dict[int, tuple[float, int, float]] = {}
    front = {1} & gains.keys()
    while front and len(kept) < leaves - 1:
        node = max(front, key=lambda n: (gains[n][0], -n))
        kept[node] = gains[node]
        front = front - {node} | {2 * node, 2 * node + 1} & gains.keys()
    return kept


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scores(rounds: list[list[Tree]], x: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            out[:, c] += tree.leaf_values(x)[:, 0]
    return out


def _scored(batch: pa.RecordBatch, fresh: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray]:
    x, s = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for k in (0, 3))
    return x, scores(fresh, x, s)


def _scoring(fresh: list[list[Tree]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _scored(batch, fresh)[1]
                new = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], new], names=batch.schema.names)

    return run


def _histograms(fresh: list[list[Tree]], made: list[Tree], open_: np.ndarray, edges: list[np.ndarray], n_bins: int, classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gradient sums of the open nodes by feature and bin."""
    width = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(open_) * width * n_bins
        g_sum, h_sum, met = np.zeros(size), np.zeros(size), np.zeros(size, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, s = _scored(batch, fresh)
            y, w = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            p = softmax(s)
            g, h = (p - (y[:, None] == np.arange(classes))) * w[:, None], p * (1 - p) * w[:, None]
            bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
            for rows, at in _open_rows(made, x, open_):
                c = int(open_[at[0], 0]) if len(at) else 0
                for f in range(width):
                    cell = (at * width + f) * n_bins + bins[rows, f]
                    np.add.at(g_sum, cell, g[rows, c])
                    np.add.at(h_sum, cell, h[rows, c])
                    met[cell] = True
        cell = np.flatnonzero(met)
        i, f, b = np.unravel_index(cell, (len(open_), width, n_bins))
        yield _emit(["i", "f", "b", "g", "h"], [i, f, b, g_sum[cell], h_sum[cell]])

    return run


def _best_splits(hist: DataFrame, ridge: float, min_weight: float) -> DataFrame:
    """Of each open node i its sums g and h and the split (feature f, last bin b on the left, -1 for none) of the highest gain above 0, with the
    left side's sums; the first of equals."""
    bins = F.sort_array(F.collect_list(F.struct("b", "g", "h")))
    per = hist.groupBy("i", "f").agg(bins.alias("bins"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    zero = F.struct(F.lit(0.0).alias("gl"), F.lit(0.0).alias("hl"), F.lit(0.0).alias("gain"), F.lit(-1).cast("long").alias("b"), F.lit(0.0).alias("bg"), F.lit(0.0).alias("bh"))

    def step(acc, x):
        gl, hl = acc["gl"] + x["g"], acc["hl"] + x["h"]
        gr, hr = F.col("g") - gl, F.col("h") - hl
        gain = gl * gl / (hl + ridge) + gr * gr / (hr + ridge) - F.col("g") * F.col("g") / (F.col("h") + ridge)
        better = (hl >= min_weight) & (hr >= min_weight) & (gain > acc["gain"] + 1e-12)
        keep = lambda new, old: F.when(better, new).otherwise(acc[old])
        return F.struct(gl.alias("gl"), hl.alias("hl"), keep(gain, "gain").alias("gain"), keep(x["b"], "b").alias("b"), keep(gl, "bg").alias("bg"), keep(hl, "bh").alias("bh"))

    found = per.withColumn("m", F.aggregate("bins", zero, step))
    best = found.groupBy("i").agg(F.max_by(F.struct("f", "m", "g", "h"), F.struct(F.col("m.gain"), -F.col("f"))).alias("s"))
    return best.select("i", "s.f", F.col("s.m.b").alias("b"), F.col("s.m.gain").alias("gain"), F.col("s.m.bg").alias("gl"), F.col("s.m.bh").alias("hl"), "s.g", "s.h")


def with_probabilities(df: DataFrame, model: ExtraTrees | Boosting, features: list[str], keep: list[str]) -> DataFrame:
    """The kept columns and ``probabilities``, one per class."""
    rows = df.select(*keep, F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = model.probabilities(batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], names=[*keep, "probabilities"])

    return rows.mapInArrow(run, f"{kinds}, probabilities array<double>")
