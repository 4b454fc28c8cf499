"""Street networks: orientation, classes, endpoint nodes, the graph, reach within a cost, and service areas.

Shortest paths are relaxation rounds over (source, node, cost) rows: a join with the edges and a minimum per round, stopped once
nothing gets shorter.  All sources advance together, distances beyond the cutoff never appear, and no task holds the graph.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import scalar as S

from .ranking import cut as _cut


def orientation(pieces: DataFrame, keys: list[str], bins: int = 12) -> DataFrame:
    """Length, normalised entropy and dominant share of bearings, and bins used (entropy over ln of all bins)."""
    binned = pieces.groupBy(*keys, S.orientation_bin(F.col("dx"), F.col("dy"), bins).alias("bin")).agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("k"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    p = binned.withColumn("p", F.col("n") / total)
    entropy = -F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(float(bins)))
    return p.groupBy(*keys).agg(F.sum("n").alias("road_length"), F.sum("k").alias("pieces"), entropy.alias("entropy"), F.max("p").alias("dominant_share"), F.count(F.lit(1)).alias("bins_used"))


def class_lengths(pieces: DataFrame, keys: list[str], class_col: str, motorway: str, cell_area: float) -> DataFrame:
    """Known-class, motorway and other lengths, densities and the motorway share; a blank class counts as other."""
    kind = F.upper(F.trim(F.coalesce(F.col(class_col).cast("string"), F.lit(""))))
    fast = kind == motorway.strip().upper()

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("length")).otherwise(0.0))

    out = pieces.groupBy(*keys).agg(total(kind != "").alias("known_length"), total(fast).alias("motorway_length"), total(~fast).alias("other_length"))
    km2 = cell_area / 1e6
    return out.select("*", (F.col("motorway_length") / km2).alias("motorway_density"), (F.col("other_length") / km2).alias("other_density"), (F.col("motorway_length") / (F.col("motorway_length") + F.col("other_length"))).alias("motorway_share"))


def endpoints(segments: DataFrame, snaps: list[float], order: str) -> DataFrame:
    """Nodes per snap size: key, degree (ends that snap there) and the coordinates of the first end in order."""
    ends = segments.select(F.col(order).alias("seq"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.lit(1).alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("e")).select("seq", "e.*")
    each = ends.withColumn("snap_size", F.explode(F.array(*[F.lit(float(s)) for s in snaps])))
    key_x, key_y = F.rint(F.col("x") / F.col("snap_size")).cast("long"), F.rint(F.col("y") / F.col("snap_size")).cast("long")
    first = F.struct("seq", "k")
    return each.groupBy("snap_size", key_x.alias("kx"), key_y.alias("ky")).agg(F.count(F.lit(1)).alias("degree"), F.min_by("x", first).alias("x"), F.min_by("y", first).alias("y"))


def snap_summary(nodes: DataFrame) -> DataFrame:
    kind = S.node_class(F.col("degree"))
    return nodes.groupBy("snap_size").agg(F.count(F.lit(1)).alias("nodes"), F.sum((kind == "intersection").cast("long")).alias("intersections"), F.sum((kind == "dead_end").cast("long")).alias("dead_ends"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))


def node_metrics(nodes: DataFrame, keys: list[str], cell_area: float) -> DataFrame:
    """Node, intersection and dead-end counts and densities of a cell, mean degree and dead-end share."""
    out = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("degree") >= 3).cast("long")).alias("intersections"), F.sum((F.col("degree") == 1).cast("long")).alias("dead_ends"), F.avg("degree").alias("mean_degree"))
    km2 = cell_area / 1e6
    return out.select("*", (F.col("nodes") / km2).alias("node_density"), (F.col("intersections") / km2).alias("intersection_density"), (F.col("dead_ends") / F.col("nodes")).alias("dead_end_share"))


NODE_BASE = 1 << 31


def node_number(x: Column, y: Column, snap: float) -> Column:
    return S.snap(x, snap) * F.lit(NODE_BASE) + S.snap(y, snap)


def exclude_types(segments: DataFrame, column: str, types: list[str]) -> DataFrame:
    """Segments whose type, trimmed and in upper case, is none of the given; a missing type stays."""
    return segments.filter(~F.upper(F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))).isin([t.strip().upper() for t in types]))


def graph_edges(segments: DataFrame, snap: float, bins: int = 12) -> DataFrame:
    """Undirected edges a < b of snapped ends (ids kx * 2^31 + ky) with length and bearing bin, the shortest of parallels; loops and
    zero lengths go."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ends = segments.select(node_number(F.col("x0"), F.col("y0"), snap).alias("p"), node_number(F.col("x1"), F.col("y1"), snap).alias("q"), F.hypot(dx, dy).alias("length"), S.orientation_bin(dx, dy, bins).alias("bin"))
    ends = ends.filter("p != q AND length > 0")
    best = ends.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min(F.struct("length", "bin")).alias("m"))
    return best.select("a", "b", "m.length", "m.bin")


def graph_nodes(edges: DataFrame, snap: float) -> DataFrame:
    """node, x and y (its snapped place) of all nodes of the edges."""
    low = F.pmod(F.col("node") + (NODE_BASE >> 1), F.lit(NODE_BASE)) - (NODE_BASE >> 1)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.select("node", ((F.col("node") - low) / NODE_BASE * snap).alias("x"), (low * float(snap)).alias("y"))


#: Bins of no more than so many snapped nodes across are cut node by node.
NODES_ACROSS = 64


def planarize(segments: DataFrame, snap: float, size: float, key: str = "id") -> DataFrame:
    """Segments (key, x0, y0, x1, y1) cut wherever two of them cross or touch, as x0, y0, x1, y1 of the parts on the snap lattice.

    With a coarse snap many crossings of a segment fall on one node, and it is enough to know which nodes it is cut at; see
    ``_cut_nodes``.  With a fine one every crossing is a node of its own and comes from the pairs of segments.
    """
    own = segments.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return _cut_nodes(own, snap) if size <= NODES_ACROSS * snap else _cut_pairs(own, snap, size)


def planar_edges(segments: DataFrame, snap: float, size: float, across: int = 16) -> DataFrame:
    """Edges a < b and length of the graph of the segments' parts between all their crossings: ``graph_edges`` of ``planarize``.

    With a coarse snap a block of nodes makes each of its edges once, however many segments run along it, and a segment is only followed from
    block to block, by one row for each.
    """
    own = segments.select(F.monotonically_increasing_id().alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    if size > NODES_ACROSS * snap:
        own = _cut(own)
        return graph_edges(_cut_pairs(own, snap, size), snap).select("a", "b", "length")
    found = _in_blocks(own, across * snap, across).groupBy("r", "c").applyInArrow(block_edges(snap, across), "id long, away long, first long, last long")
    inside = F.col("id").isNull()
    along = Window.partitionBy("id", F.when(inside, F.col("first"))).orderBy("away", "first")
    ends = found.select(inside.alias("_inside"), "first", "last", F.lead("first").over(along).alias("_next"))
    ends = ends.select(F.when(F.col("_inside"), F.col("first")).otherwise(F.col("last")).alias("p"), F.when(F.col("_inside"), F.col("last")).otherwise(F.col("_next")).alias("q")).filter("p != q")
    edges = ends.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()

    def place(n: str) -> tuple[Column, Column]:
        low = F.pmod(F.col(n) + (NODE_BASE >> 1), F.lit(NODE_BASE)) - (NODE_BASE >> 1)
        return (F.col(n) - low) / NODE_BASE * float(snap), low * float(snap)

    (ax, ay), (bx, by) = place("a"), place("b")
    return edges.select("a", "b", F.hypot(bx - ax, by - ay).alias("length"))


def _in_blocks(own: DataFrame, width: float, across: int) -> DataFrame:
    """Segments with each block (r, c) of nodes that their bounds touch."""

    def blocks(a: str, b: str) -> Column:
        # Node k holds what is nearer than half a snap; a little more, for what rounding moves.
        low, high = F.least(a, b) / width + 0.5 / across - 1e-6, F.greatest(a, b) / width + 0.5 / across + 1e-6
        return F.explode(F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long")))

    return own.withColumn("r", blocks("y0", "y1")).withColumn("c", blocks("x0", "x1"))


def _cut_nodes(own: DataFrame, snap: float, across: int = 8) -> DataFrame:
    """Parts of segments between the nodes of the snap lattice at which they are cut.

    A segment has as many rows as blocks of ``across`` by ``across`` nodes that it passes, and gets from each the nodes where another one
    cuts it; a node once cut is settled, so what is compared grows with the nodes and not with the crossings.
    """
    found = _in_blocks(own, across * snap, across).groupBy("r", "c").applyInArrow(block_cuts(snap, across), f"id {dict(own.dtypes)['id']}, x0 double, y0 double, x1 double, y1 double, nodes array<long>")
    whole = found.groupBy("id", "x0", "y0", "x1", "y1").agg(F.flatten(F.collect_list("nodes")).alias("nodes"))

    def place(x: Column, y: Column) -> Column:
        away = F.abs(x - F.rint(F.col("x0") / snap)) + F.abs(y - F.rint(F.col("y0") / snap))
        return F.struct(away.alias("away"), x.alias("x"), y.alias("y"))

    def decoded(n: Column) -> Column:
        low = F.pmod(n + (NODE_BASE >> 1), F.lit(NODE_BASE)) - (NODE_BASE >> 1)
        return place(((n - low) / NODE_BASE).cast("double"), low.cast("double"))

    # Along a segment nodes only move away from its start, and each is one stretch of it.
    ends = [place(*[F.rint((F.col(f"{c}0") + t * (F.col(f"{c}1") - F.col(f"{c}0"))) / snap) for c in "xy"]) for t in (F.lit(0.0), F.lit(1.0))]
    steps = F.array_sort(F.array_distinct(F.concat(F.array(*ends), F.transform("nodes", decoded))))
    way = whole.select("id", steps.alias("n"))
    parts = way.select("id", F.explode(F.arrays_zip(F.slice("n", F.lit(1), F.size("n") - 1).alias("a"), F.slice("n", F.lit(2), F.size("n") - 1).alias("b"))).alias("p"))
    return parts.select("id", *[(F.col(f"p.{e}.{c}") * snap).alias(f"{c}{k}") for k, e in ((0, "a"), (1, "b")) for c in "xy"])


def block_cuts(snap: float, across: int, batch: int = 1 << 20) -> Callable[[pa.Table], pa.Table]:
    """The segments of one block with the nodes of the block at which another one of them cuts each."""
    hits = block_hits(snap, across, batch)

    def run(table: pa.Table) -> pa.Table:
        row, kx, ky = hits(table)
        offsets = np.searchsorted(row, np.arange(len(table) + 1)).astype(np.int32)
        nodes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(kx * NODE_BASE + ky))
        return pa.table({**{n: table[n] for n in ("id", "x0", "y0", "x1", "y1")}, "nodes": nodes})

    return run


def block_edges(snap: float, across: int, batch: int = 1 << 20) -> Callable[[pa.Table], pa.Table]:
    """Of the nodes of one block at which its segments are cut (see ``block_hits``) the pairs that follow each other on a segment, each once
    (id is null), and for each segment its first and last node there, and how far the first is from its start."""
    hits = block_hits(snap, across, batch)

    def run(table: pa.Table) -> pa.Table:
        row, kx, ky = hits(table)
        x0, y0 = (np.rint(table[c].to_numpy() / snap) for c in ("x0", "y0"))
        away = (np.abs(kx - x0[row]) + np.abs(ky - y0[row])).astype(np.int64)
        order = np.lexsort((ky, kx, away, row))
        row, away, node = row[order], away[order], (kx * NODE_BASE + ky)[order]
        same = row[1:] == row[:-1]
        a, b = np.minimum(node[:-1], node[1:])[same], np.maximum(node[:-1], node[1:])[same]
        by = np.lexsort((b, a))
        a, b = a[by], b[by]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        a, b = a[new], b[new]
        begin, end = np.append(True, ~same)[: len(row)], np.append(~same, True)[: len(row)]
        ids = table["id"].to_numpy()[row[begin]]
        return pa.table({
            "id": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(ids)]), "away": np.concatenate([np.zeros(len(a), np.int64), away[begin]]),
            "first": np.concatenate([a, node[begin]]), "last": np.concatenate([b, node[end]]),
        })

    return run


def block_hits(snap: float, across: int, batch: int = 1 << 20) -> Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The nodes of one block at which its segments are cut by another one: row of the segment (in order), and the node's place.

    Segments are listed under the nodes they come near, in mixed order.  Every listed one looks at the next of its node, then the next two,
    four and so on, until one cuts it there or it has seen all; about as many looks as the share of those that cut it demands.
    """

    def run(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x0, y0, x1, y1 = (table[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
        r, c = table["r"][0].as_py() * across, table["c"][0].as_py() * across
        dx, dy = x1 - x0, y1 - y0
        slack = 1e-6 * snap
        rows, kx, ky = [], [], []
        for y in range(r, r + across):
            low, high = (y - 0.5) * snap - slack, (y + 0.5) * snap + slack
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = (low - y0) / dy, (high - y0) / dy
            level = dy == 0
            a, b = np.where(level, 0.0, np.minimum(a, b)), np.where(level, 1.0, np.maximum(a, b))
            a, b = np.clip(a, 0.0, 1.0), np.clip(b, 0.0, 1.0)
            near = (np.minimum(y0, y1) <= high) & (np.maximum(y0, y1) >= low)
            p, q = x0 + a * dx, x0 + b * dx
            first = np.maximum(np.floor((np.minimum(p, q) - slack) / snap + 0.5), c)
            last = np.minimum(np.floor((np.maximum(p, q) + slack) / snap + 0.5), c + across - 1)
            n = np.where(near, np.maximum(last - first + 1, 0), 0).astype(np.int64)
            own = np.repeat(np.arange(len(x0)), n)
            rows.append(own)
            kx.append(first.astype(np.int64)[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
            ky.append(np.full(len(own), y, np.int64))
        row, kx, ky = np.concatenate(rows), np.concatenate(kx), np.concatenate(ky)
        mixed = np.random.default_rng(7).permutation(len(row))
        # Few enough nodes for a sort by counting.
        place = ((ky - r) * across + kx - c).astype(np.uint16 if across <= 256 else np.int64)
        order = mixed[np.argsort(place[mixed], kind="stable")]
        row, kx, ky = row[order], kx[order], ky[order]
        new = np.concatenate([[True], (kx[1:] != kx[:-1]) | (ky[1:] != ky[:-1])]) if len(row) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        start, many = begin[group], np.diff(np.append(begin, len(row)))[group]

        def here(i: np.ndarray, t: np.ndarray) -> np.ndarray:
            k = row[i]
            with np.errstate(invalid="ignore"):
                return (t > 0) & (t < 1) & (np.rint((x0[k] + t * dx[k]) / snap) == kx[i]) & (np.rint((y0[k] + t * dy[k]) / snap) == ky[i])

        hit = np.zeros(len(row), bool)
        for t in (0.0, 1.0):
            hit |= (np.rint((x0 + t * dx) / snap)[row] == kx) & (np.rint((y0 + t * dy) / snap)[row] == ky)
        open_, seen = np.flatnonzero(~hit & (many > 1)), 1
        step = 1
        while len(open_):
            for at in range(0, len(open_), max(1, batch // step)):
                some = open_[at : at + max(1, batch // step)]
                left = np.minimum(many[some] - seen, step)
                i = np.repeat(some, left)
                ahead = seen + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
                j = start[i] + (i - start[i] + ahead) % many[i]
                k, o = row[i], row[j]
                rx, ry, sx, sy, qx, qy = dx[k], dy[k], dx[o], dy[o], x0[o] - x0[k], y0[o] - y0[k]
                cross, beside = rx * sy - ry * sx, qx * ry - qy * rx
                with np.errstate(divide="ignore", invalid="ignore"):
                    t, u = (qx * sy - qy * sx) / cross, beside / cross
                    cuts = (cross != 0) & (u >= 0) & (u <= 1) & here(i, t)
                    along = np.flatnonzero((cross == 0) & (beside == 0))
                    if len(along):
                        w, square = along, rx[along] ** 2 + ry[along] ** 2
                        for ex, ey in ((qx[w], qy[w]), (qx[w] + sx[w], qy[w] + sy[w])):
                            cuts[w] |= here(i[w], (ex * rx[w] + ey * ry[w]) / square)
                hit[i[cuts]] = True
            seen += step
            step *= 2
            open_ = open_[~hit[open_] & (many[open_] > seen)]
        got = np.flatnonzero(hit)
        got = got[np.argsort(row[got], kind="stable")]
        return row[got], kx[got], ky[got]

    return run


def _cut_pairs(own: DataFrame, snap: float, size: float) -> DataFrame:
    """Segments meet in the bins of ``size`` that they pass through.  Two are compared once, in the bin of the lower left corner that their
    bounds have in common, and only if these overlap; both are cut there, whether they cross or lie along each other.
    """

    def bins(a: str, b: str) -> Column:
        return F.explode(F.sequence(F.floor(F.least(a, b) / size).cast("long"), F.floor(F.greatest(a, b) / size).cast("long")))

    spread = own.withColumn("r", bins("y0", "y1")).withColumn("c", bins("x0", "x1"))
    other = spread.select("r", "c", *[F.col(x).alias(f"o_{x}") for x in ("id", "x0", "y0", "x1", "y1")])

    def common(a: str, b: str, bin_: str) -> Column:
        low, high = F.greatest(F.least(a, b), F.least(f"o_{a}", f"o_{b}")), F.least(F.greatest(a, b), F.greatest(f"o_{a}", f"o_{b}"))
        return (low <= high) & (F.floor(low / size) == F.col(bin_))

    rx, ry, sx, sy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("o_x1") - F.col("o_x0"), F.col("o_y1") - F.col("o_y0")
    qx, qy = F.col("o_x0") - F.col("x0"), F.col("o_y0") - F.col("y0")
    cross, beside = rx * sy - ry * sx, qx * ry - qy * rx
    t, u = F.try_divide(qx * sy - qy * sx, cross), F.try_divide(beside, cross)
    pairs = spread.join(other, ["r", "c"]).filter((F.col("id") < F.col("o_id")) & common("x0", "x1", "c") & common("y0", "y1", "r"))

    def cut_at(who: str, t: Column, when: Column) -> Column:
        return F.struct(F.col(who).alias("id"), F.when(when & (t > 0) & (t < 1), t).alias("t"))

    crossing = (cross != 0) & t.between(0, 1) & u.between(0, 1)
    # Segments along each other cut each other at the ends of the other that lie on them.
    along = (cross == 0) & (beside == 0) & (qx * sy - qy * sx == 0)
    r2, s2 = rx * rx + ry * ry, sx * sx + sy * sy
    ends = [("id", F.try_divide(qx * rx + qy * ry, r2)), ("id", F.try_divide((qx + sx) * rx + (qy + sy) * ry, r2)), ("o_id", F.try_divide(-qx * sx - qy * sy, s2)), ("o_id", F.try_divide((rx - qx) * sx + (ry - qy) * sy, s2))]
    met = pairs.select(F.explode(F.array(cut_at("id", t, crossing), cut_at("o_id", u, crossing), *[cut_at(who, at, along) for who, at in ends])).alias("k")).select("k.*").filter("t IS NOT NULL")
    cuts = met.groupBy("id").agg(F.collect_set("t").alias("ts"))
    whole = own.join(cuts, "id", "left").withColumn("ts", F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>")))))
    parts = whole.select("id", "x0", "y0", "x1", "y1", F.explode(F.arrays_zip(F.slice("ts", F.lit(1), F.size("ts") - 1).alias("a"), F.slice("ts", F.lit(2), F.size("ts") - 1).alias("b"))).alias("p"))

    def at(axis: str, t: str) -> Column:
        point = F.col(f"{axis}0") + F.col(t) * (F.col(f"{axis}1") - F.col(f"{axis}0"))
        return F.rint(point / snap) * snap

    return parts.select("id", at("x", "p.a").alias("x0"), at("y", "p.a").alias("y0"), at("x", "p.b").alias("x1"), at("y", "p.b").alias("y1")).filter("x0 != x1 OR y0 != y1")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node it reaches) of the graph, by alternating star contraction."""
    edges = _cut(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(down, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = _cut(moved.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        sign = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
        if sign == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = sign
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def reach(edges: DataFrame, sources: DataFrame, cutoff: float, rounds: int = 10_000, fold: int = 4) -> DataFrame:
    """source, node, cost of the nodes within ``cutoff`` of each source node (columns source and, where it doesn't start at 0, cost).

    A round joins the front with the edges and keeps what is shorter than anything known.  What is known is a list of fronts, the best of
    which were partitioned by (source, node) and folded into one every ``fold`` rounds; a round itself writes its own front alone.
    """
    both = _cut(edges.select("a", "b", "length").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "length")))
    start = F.min("cost") if "cost" in sources.columns else F.lit(0.0)
    known = _cut(sources.groupBy("source").agg(start.alias("cost")).select("source", F.col("source").alias("node"), "cost").filter(F.col("cost") <= cutoff))
    front, fresh = known, []
    for k in range(rounds):
        step = front.join(both, front["node"] == both["a"]).select("source", F.col("b").alias("node"), (F.col("cost") + F.col("length")).alias("new")).filter(F.col("new") <= cutoff)
        seen = reduce(DataFrame.unionByName, fresh, known).withColumn("new", F.lit(None).cast("double"))
        both_sides = seen.unionByName(step.withColumn("cost", F.lit(None).cast("double")).select("source", "node", "cost", "new"))
        best = both_sides.groupBy("source", "node").agg(F.min("cost").alias("cost"), F.min("new").alias("new"))
        front = _cut(best.filter("new IS NOT NULL AND (cost IS NULL OR new < cost)").select("source", "node", F.col("new").alias("cost")))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, fresh, known).groupBy("source", "node").agg(F.min("cost").alias("cost"))
        fresh.append(front)
        if k % fold == fold - 1:
            known = _cut(reduce(DataFrame.unionByName, fresh, known).groupBy("source", "node").agg(F.min("cost").alias("cost")))
            fresh = []
    raise RuntimeError(f"paths did not settle in {rounds} rounds")


def service_area(edges: DataFrame, reached: DataFrame, costs: list[float], bins: int = 12) -> DataFrame:
    """Per source and cost: edge length and edges reached (edges count as far as the cost left at each end goes), nodes, intersections,
    dead ends, both per network km, mean degree, and entropy and dominant share of bearings weighted by the length reached."""
    limits = F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("limit")
    ends = edges.select("a", "b", "length", "bin", F.explode(F.array("a", "b")).alias("node"))
    left = reached.select("source", "node", "cost", limits).filter("cost <= limit")
    parts = left.join(ends, "node").groupBy("source", "limit", "a", "b", "length", "bin").agg(F.sum(F.col("limit") - F.col("cost")).alias("left"))
    parts = parts.select("source", "limit", "bin", F.least("length", "left").alias("part")).filter("part > 0")
    by_bin = parts.groupBy("source", "limit", "bin").agg(F.sum("part").alias("n"), F.count(F.lit(1)).alias("k"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("source", "limit"))
    by_bin = by_bin.withColumn("p", p)
    lengths = by_bin.groupBy("source", "limit").agg(F.sum("n").alias("service_length"), F.sum("k").alias("service_edges"), (-F.sum(F.col("p") * F.ln("p")) / F.ln(F.lit(float(bins)))).alias("entropy"), F.max("p").alias("dominant_share"))
    degree = F.col("degree")
    nodes = left.join(degrees(edges), "node", "left").groupBy("source", "limit").agg(F.count(F.lit(1)).alias("service_nodes"), F.sum((degree >= 3).cast("long")).alias("intersections"), F.sum((degree == 1).cast("long")).alias("dead_ends"), F.avg("degree").alias("mean_degree"))
    km = F.col("service_length") / 1000
    out = nodes.join(lengths, ["source", "limit"], "left").fillna(0, ["service_edges"]).withColumn("service_length", F.coalesce("service_length", F.lit(0.0)))
    return out.select("source", "limit", "service_length", "service_edges", "service_nodes", "intersections", "dead_ends", F.when(km > 0, F.col("intersections") / km).alias("intersections_per_km"), F.when(km > 0, F.col("dead_ends") / km).alias("dead_ends_per_km"), "mean_degree", "entropy", "dominant_share")
