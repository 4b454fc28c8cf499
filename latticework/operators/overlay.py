"""Unions, intersections and differences of polygon tables, as polygons.

Edges, not polygons, are dealt to the squares of a lattice: each is cut at the lattice lines by arithmetic, and a square gets the cut edges and
the winding number at its lower left corner, a running sum along its lattice row.  A square without edges is all in or all out by that number
alone.  In the others a sweep over slabs gives the area and the outline of what is kept, chained into paths that end at the square's
sides; what two neighbours keep on both sides of a line cancels, the rest of the line is outline.  Paths become rings by next-edge pointers
and pointer doubling (``rings``).  No task sees more than one square's edges, and no polygon travels whole.

Coordinates are rounded to multiples of a grain (2^-20 by default), so equal points are equal numbers in all squares.  Outlines are sums of
the slabs' trapezoids, so they are closed whatever is rounded.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import cut
from .rings import next_lines, ring_order, rings_of
from .squares import GRAIN, corner_windings, oriented_edges, points_in_regions, square_edges

POINTS = "array<struct<x:double,y:double,edge:long>>"
KINDS = ("union", "intersection", "difference")
#: Which part a row of ``square_parts`` is.
PATH, RING, SIDE, AREA = "path", "ring", "side", "area"


class Square:
    """The sweep over one square: parts of both layers, their windings at the lower left corner."""

    def __init__(self, box: tuple[float, float, float, float], parts: np.ndarray, up: np.ndarray, layer: np.ndarray, edge: np.ndarray, winds: tuple[int, int], grain: float) -> None:
        self.box, self.p, self.up, self.layer, self.edge, self.winds, self.grain = box, parts, up, layer, edge, winds, grain

    def at(self, rows: np.ndarray, y: float) -> np.ndarray:
        x0, y0, x1, y1 = self.p[rows].T
        x = np.rint((x0 + (y - y0) * (x1 - x0) / (y1 - y0)) / self.grain) * self.grain
        return np.where(y == y0, x0, np.where(y == y1, x1, x))

    def heights(self) -> np.ndarray:
        """Ends of parts, crossings of two, and the square's own."""
        p, found = self.p, [self.p[:, 1], self.p[:, 3], np.array([self.box[1], self.box[3]])]
        x0, y0, x1, y1 = p.T
        dx, dy = x1 - x0, y1 - y0
        left, right = np.minimum(x0, x1), np.maximum(x0, x1)
        for a in range(0, len(p), 256):
            s = slice(a, a + 256)
            i, j = np.nonzero((left[s, None] <= right) & (right[s, None] >= left) & (y0[s, None] <= y1) & (y1[s, None] >= y0))
            i += a
            i, j = i[i < j], j[i < j]
            turn = dx[i] * dy[j] - dy[i] * dx[j]
            i, j, turn = i[turn != 0], j[turn != 0], turn[turn != 0]
            t = ((x0[j] - x0[i]) * dy[j] - (y0[j] - y0[i]) * dx[j]) / turn
            u = ((x0[j] - x0[i]) * dy[i] - (y0[j] - y0[i]) * dx[i]) / turn
            on = (t > 0) & (t < 1) & (u > 0) & (u < 1)
            found.append(np.rint((y0[i[on]] + t[on] * dy[i[on]]) / self.grain) * self.grain)
        ys = np.unique(np.concatenate(found))
        return ys[(ys >= self.box[1]) & (ys <= self.box[3])]

    def keep(self, winds: np.ndarray, how: str, rule: str) -> np.ndarray:
        a, b = (winds != 0 if rule == "nonzero" else winds > 0)
        return a & b if how == "intersection" else a & ~b if how == "difference" else a | b

    def sweep(self, how: str, rule: str) -> tuple[float, dict, list[tuple[str, float, float, float, int]]]:
        """Area kept, outline inside the square (from, to: the edge) and what is kept along its sides (axis, line, from, to, sign)."""
        p, (west, south, east, north) = self.p, self.box
        steep = np.flatnonzero(p[:, 1] != p[:, 3])
        order = steep[np.argsort(p[steep, 1], kind="stable")]
        starts, active, done = p[order, 1], np.zeros(0, int), 0
        # Where a part meets the left side, the winding along that side changes by one.
        ends = [(p[k, 1], 1 if self.up[k] else -1, k) for k in np.flatnonzero(p[:, 0] == west)] + [(p[k, 3], -1 if self.up[k] else 1, k) for k in np.flatnonzero(p[:, 2] == west)]
        ends = sorted((h, s, int(self.layer[k])) for h, s, k in ends if south < h)
        wind, met = np.array(self.winds), 0
        area, lines, sides = 0.0, defaultdict(lambda: [0, 0]), []
        levels: dict[float, list[tuple[float, float, int]]] = defaultdict(list)
        ys = self.heights()
        for low, high in zip(ys[:-1].tolist(), ys[1:].tolist(), strict=True):
            middle = (low + high) / 2
            upto = int(np.searchsorted(starts, middle))
            active = np.concatenate([active, order[done:upto]])
            done = upto
            active = active[p[active, 3] > middle]
            while met < len(ends) and ends[met][0] < middle:
                wind[ends[met][2]] += ends[met][1]
                met += 1
            bottom, top = self.at(active, low), self.at(active, high)
            by = np.lexsort((top - bottom, bottom + top))
            rows, bottom, top = active[by], bottom[by], top[by]
            change = np.where(self.up[rows], -1, 1)
            winds = np.stack([wind[k] + np.concatenate([[0], np.cumsum(np.where(self.layer[rows] == k, change, 0))]) for k in (0, 1)])
            kept = self.keep(winds, how, rule)
            xb, xt = [west, *bottom.tolist(), east], [west, *top.tolist(), east]
            if kept[0]:
                sides.append(("x", west, low, high, -1))
            if kept[-1]:
                sides.append(("x", east, low, high, 1))
            for k in np.flatnonzero(kept[1:] != kept[:-1]).tolist():
                line = lines[(xb[k + 1], low), (xt[k + 1], high)]
                line[0] += 1 if kept[k] else -1
                line[1] = int(self.edge[rows[k]])
            for k in np.flatnonzero(kept).tolist():
                area += (xb[k + 1] - xb[k] + xt[k + 1] - xt[k]) / 2 * (high - low)
                levels[low].append((xb[k], xb[k + 1], 1))
                levels[high].append((xt[k], xt[k + 1], -1))
        out = {}
        for (a, b), (n, edge) in lines.items():
            for _ in range(abs(n)):
                out.setdefault(a if n > 0 else b, []).append((b if n > 0 else a, edge))
        for y, spans in levels.items():
            if y in (south, north):
                sides += [("y", y, a, b, s) for a, b, s in spans if a != b]
                continue
            for a, b, n in net(spans):
                for _ in range(abs(n)):
                    out.setdefault((a if n > 0 else b, y), []).append(((b if n > 0 else a, y), hash(y)))
        return area, out, sides


def net(spans: list[tuple[float, float, int]]) -> list[tuple[float, float, int]]:
    """Stretches of a line with the sum of the signs of the spans over them, where it isn't 0 (a span drawn backwards counts against)."""
    change: dict[float, int] = defaultdict(int)
    for a, b, s in spans:
        change[a] += s
        change[b] -= s
    places, n, out = sorted(k for k, v in change.items() if v), 0, []
    for a, b in zip(places, places[1:], strict=False):
        n += change[a]
        if n:
            out.append((a, b, n))
    return out


def chains(out: dict, box: tuple[float, float, float, float]) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Paths from side to side and closed rings of outline lines, each a list of (x, y, edge) and an end; the kept side is on the left.

    Where several lines leave a point, the next is the first clockwise from the way back, so areas that only touch stay apart.
    """
    on_side = lambda v: v[0] in (box[0], box[2]) or v[1] in (box[1], box[3])

    def walk(start: tuple) -> list[tuple]:
        path, here, back = [], start, None
        while True:
            ways = out[here]
            k = 0
            if len(ways) > 1 and back is not None:
                angles = [math.atan2(w[0][1] - here[1], w[0][0] - here[0]) for w in ways]
                k = min(range(len(ways)), key=lambda i: (back - angles[i]) % (2 * math.pi) or 2 * math.pi)
            to, edge = ways.pop(k)
            if not ways:
                del out[here]
            path.append((*here, edge))
            back = math.atan2(here[1] - to[1], here[0] - to[0])
            here = to
            if on_side(here) or here == start:
                path.append((*here, 0))
                return path

    paths = []
    for start in [v for v in out if on_side(v)]:
        while start in out:
            paths.append(walk(start))
    rings = []
    while out:
        rings.append(walk(next(iter(out))))
    return paths, rings


def thinned(path: list[tuple]) -> list[tuple]:
    """Without the points where the same edge goes on."""
    return [path[0], *[v for u, v in zip(path, path[1:], strict=False) if u[2] != v[2]]]


def square_parts(left: DataFrame, right: DataFrame | None, how: str, keys: list[str], size: float, rings: str = "rings", grain: float = GRAIN, rule: str = "positive", outline: bool = True) -> DataFrame:
    """The parts of the result in each square, checkpointed: keys, row_id, col_id, kind and what belongs to it.

    ``area`` rows have the area kept; ``path`` and ``ring`` rows points; ``side`` rows what is kept along a side (axis, line, low, high, sign).  Without ``outline`` there are only areas.
    """
    if how not in KINDS:
        raise ValueError(f"how must be one of {KINDS}")
    if grain <= 0 or size / grain != round(size / grain):
        raise ValueError("the size of squares must be a multiple of the grain")
    drawn = rule == "nonzero"
    mine = cut(square_edges(oriented_edges(left, keys, rings, grain, drawn), size, grain).withColumn("layer", F.lit(0)))
    winds = corner_windings(mine, keys, size).withColumn("layer", F.lit(0))
    parts = mine
    if right is not None:
        shared = all(k in right.columns for k in keys)
        own = keys if shared else []
        other = cut(square_edges(oriented_edges(right, own, rings, grain, drawn), size, grain).withColumn("layer", F.lit(1)))
        turns = corner_windings(other, own, size).withColumn("layer", F.lit(1))
        if not shared:
            cells = cut(mine.select(*keys, "row_id", "col_id").union(winds.select(*keys, "row_id", "col_id")).distinct())
            other, turns = (d.join(cells, ["row_id", "col_id"]) for d in (other, turns))
        parts, winds = mine.unionByName(other.select(*mine.columns)), winds.unionByName(turns.select(*winds.columns))
    cell = [*keys, "row_id", "col_id"]
    by_layer = [F.coalesce(F.sum(F.when(F.col("layer") == k, F.col("wind"))), F.lit(0)).cast("int").alias(f"wind{k}") for k in (0, 1)]
    corners = cut(winds.groupBy(*cell).agg(*by_layer))
    inner = parts.filter("NOT on_line").select(*cell, "layer", "up", "edge", "px0", "py0", "px1", "py1")
    busy = inner.select(*cell).distinct()
    fields = inner.withColumn("wind0", F.lit(None).cast("int")).withColumn("wind1", F.lit(None).cast("int"))
    fed = fields.unionByName(corners.join(busy, cell, "left_semi"), allowMissingColumns=True)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = int(pdf.row_id.iloc[0]), int(pdf.col_id.iloc[0])
        box = (col * size, row * size, (col + 1) * size, (row + 1) * size)
        edges, corner = pdf[pdf.edge.notna()], pdf[pdf.edge.isna()]
        winds = (int(corner.wind0.iloc[0]), int(corner.wind1.iloc[0])) if len(corner) else (0, 0)
        # An edge's name is a long; beside nulls pandas would make it a float, so names travel as text.
        square = Square(box, edges[["px0", "py0", "px1", "py1"]].to_numpy(float), edges.up.to_numpy(bool), edges.layer.to_numpy(int), edges.edge.astype("int64").to_numpy(), winds, grain)
        area, out, sides = square.sweep(how, rule)
        paths, closed = chains(out, box) if outline else ([], [])
        rows = [(AREA, area, None, None, None, None, None, None)] if area else []
        rows += [(kind, None, [{"x": x, "y": y, "edge": e} for x, y, e in thinned(p)], None, None, None, None, None) for kind, found in ((PATH, paths), (RING, closed)) for p in found]
        rows += [(SIDE, None, None, axis, line, a, b, s) for axis, line, a, b, s in sides if outline]
        made = pd.DataFrame(rows, columns=["kind", "area", "points", "axis", "line", "low", "high", "sign"])
        for k in reversed(cell):
            made.insert(0, k, pdf[k].iloc[0])
        return made

    kinds = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in cell)
    swept = fed.withColumn("edge", F.col("edge").cast("string")).groupBy(*cell).applyInPandas(one, f"{kinds}, kind string, area double, points {POINTS}, axis string, line double, low double, high double, sign int")
    a, b = (F.col(f"wind{k}") != 0 if drawn else F.col(f"wind{k}") > 0 for k in (0, 1))
    kept = a & b if how == "intersection" else a & ~b if how == "difference" else a | b
    full = corners.join(busy, cell, "left_anti").filter(kept)
    x, y = F.col("col_id") * size, F.col("row_id") * size
    side = lambda axis, line, low, sign: F.struct(F.lit(SIDE).alias("kind"), F.lit(None).cast("double").alias("area"), F.lit(axis).alias("axis"), line.cast("double").alias("line"), low.cast("double").alias("low"), (low + size).cast("double").alias("high"), F.lit(sign).alias("sign"))
    whole = F.struct(F.lit(AREA).alias("kind"), F.lit(float(size * size)).alias("area"), *[F.lit(None).cast(t).alias(c) for c, t in (("axis", "string"), ("line", "double"), ("low", "double"), ("high", "double"), ("sign", "int"))])
    pieces = [whole, side("x", x, y, -1), side("x", x + size, y, 1), side("y", y, x, 1), side("y", y + size, x, -1)] if outline else [whole]
    around = full.select(*cell, F.explode(F.array(*pieces)).alias("s")).select(*cell, "s.*")
    return cut(swept.unionByName(around, allowMissingColumns=True))


def square_areas(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_id, col_id and area of the squares that hold some of the result."""
    return parts.filter(F.col("kind") == AREA).select(*keys, "row_id", "col_id", "area").filter("area > 0")


def result_rings(parts: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys, ring (a number), points and signed area of the result's rings: shells counter-clockwise, holes clockwise.

    What is kept on both sides of a lattice line cancels in a running sum of changes along the side of one square.
    """
    side = [*keys, "axis", "line", "_s"]
    spans = parts.filter(F.col("kind") == SIDE).withColumn("_s", F.when(F.col("axis") == "x", F.col("row_id")).otherwise(F.col("col_id")))
    changes = spans.select(*side, F.explode(F.array(F.struct(F.col("low").alias("at"), F.col("sign").alias("n")), F.struct(F.col("high").alias("at"), (-F.col("sign")).alias("n")))).alias("c"))
    summed = changes.groupBy(*side, F.col("c.at").alias("at")).agg(F.sum("c.n").alias("n")).filter("n != 0")
    along = Window.partitionBy(*side).orderBy("at")
    open_ = summed.withColumn("n", F.sum("n").over(along)).withColumn("to", F.lead("at").over(along)).filter("n != 0 AND to IS NOT NULL").withColumn("_k", F.explode(F.sequence(F.lit(1), F.abs("n"))))
    a, b = (F.when(F.col("n") > 0, F.col(p)).otherwise(F.col(q)) for p, q in (("at", "to"), ("to", "at")))
    name = F.xxhash64("axis", "line")
    corner = lambda v, e: F.struct(F.when(F.col("axis") == "x", F.col("line")).otherwise(v).alias("x"), F.when(F.col("axis") == "x", v).otherwise(F.col("line")).alias("y"), e.alias("edge"))
    lines = open_.select(*keys, F.array(corner(a, name), corner(b, F.lit(0).cast("long"))).cast(POINTS).alias("points"))
    paths = parts.filter(F.col("kind") == PATH).select(*keys, "points").unionByName(lines)
    closed = parts.filter(F.col("kind") == RING).select(*keys, "points")
    return rings_of(paths, closed, keys)


def assemble(rings: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys, part, area and rings: each shell with its holes, parts numbered from 1 by the shell's lower left point.

    A hole belongs to the smallest shell around a point a quarter of a grain to the left of the middle of its first edge: what is kept is
    there, and outlines meet in points only.  A hole in no shell is left out.
    """
    shells, holes = rings.filter("area > 0"), rings.filter("area < 0")
    a, b = F.col("points")[0], F.col("points")[1]
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    step = GRAIN / 4 / F.hypot(dx, dy)
    marks = holes.select("ring", ((a["x"] + b["x"]) / 2 - dy * step).alias("x"), ((a["y"] + b["y"]) / 2 + dx * step).alias("y"))
    held = points_in_regions(marks, "ring", shells.select(F.col("ring").alias("shell"), F.array("points").alias("rings")), "shell", size).select("ring", "shell")
    same = holes.select("ring", *[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)])
    fits = held.join(same, "ring").join(shells.select(F.col("ring").alias("shell"), "area", *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)]), "shell")
    for i in range(len(keys)):
        fits = fits.filter(F.col(f"_h{i}").eqNullSafe(F.col(f"_s{i}")))
    of = fits.groupBy("ring").agg(F.min_by("shell", F.struct("area", "shell")).alias("shell"))
    inner = holes.select("ring", "points", "area").join(of, "ring").groupBy("shell").agg(F.sort_array(F.collect_list("points")).alias("inner"), F.sum("area").alias("less"))
    whole = shells.join(inner, shells["ring"] == inner["shell"], "left")
    lowest = F.array_min(F.transform("points", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    order = Window.partitionBy(*keys).orderBy("_low", "area") if keys else Window.partitionBy().orderBy("_low", "area")
    out = whole.select(*keys, (F.col("area") + F.coalesce("less", F.lit(0.0))).alias("area"), F.concat(F.array("points"), F.coalesce("inner", F.array().cast("array<array<struct<x:double,y:double>>>"))).alias("rings"), lowest.alias("_low"))
    return out.withColumn("part", F.row_number().over(order)).select(*keys, "part", "area", "rings")


def grouped(polygons: DataFrame, keys: list[str], rings: str) -> tuple[DataFrame, list[str]]:
    """Rings with one column for the keys, which is never null, and its name; none without keys."""
    if not keys:
        return polygons.select(rings), []
    return polygons.select(F.to_json(F.struct(*keys)).alias("_group"), rings), ["_group"]


def named(result: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """The keys' own columns in place of that one."""
    if not keys:
        return result
    each = polygons.select(F.to_json(F.struct(*keys)).alias("_group"), *keys).distinct()
    return result.join(each, "_group").select(*keys, *[c for c in result.columns if c != "_group"])


def overlay(left: DataFrame, right: DataFrame | None = None, how: str = "union", keys: list[str] | None = None, size: float = 1000.0, rings: str = "rings", grain: float = GRAIN) -> DataFrame:
    """Polygons of ``left`` with the same keys made one, or cut by those of ``right``: keys, part (a number from 1), area and rings (shell, then holes).

    ``how``: union, intersection or difference.  If ``right`` lacks the keys it is one study area for all.  A polygon is a list of rings,
    shell first; how rings are drawn doesn't matter.  Polygons may overlap, touch and repeat; rings that cross themselves need ``mended``
    first.  Null and empty polygons and rings of under three points count as nothing; an empty table gives an empty one.
    """
    keys = keys or []
    own, group = grouped(left, keys, rings)
    if right is not None:
        right = grouped(right, keys, rings)[0] if set(keys) <= set(right.columns) else right.select(rings)
    parts = square_parts(own, right, how, group, float(size), rings, grain)
    return named(assemble(result_rings(parts, group, float(size)), group, float(size)), left, keys)


def mended(polygons: DataFrame, keys: list[str], size: float = 1000.0, rings: str = "rings", grain: float = GRAIN) -> DataFrame:
    """Each key's rings, however they cross themselves, as valid polygons: what they wind around, in whatever direction, counts once."""
    own, group = grouped(polygons, keys, rings)
    parts = square_parts(own, None, "union", group, float(size), rings, grain, rule="nonzero")
    return named(assemble(result_rings(parts, group, float(size)), group, float(size)), polygons, keys)


def covered_area(polygons: DataFrame, size: float, keys: list[str], rings: str = "rings") -> DataFrame:
    """keys, row_id, col_id and the area that the polygons of a key cover together in each square; where they overlap, once."""
    own, group = grouped(polygons, keys, rings)
    return named(square_areas(square_parts(own, None, "union", group, float(size), rings, outline=False), group), polygons, keys)


def dissolved_area(polygons: DataFrame, size: float, key: str, rings: str = "rings") -> DataFrame:
    """The area of each key's polygons made one."""
    return covered_area(polygons, size, [key], rings).groupBy(key).agg(F.sum("area").alias("area"))


def clipped_area(regions: DataFrame, region: str, study: DataFrame, size: float, rings: str = "rings") -> DataFrame:
    """region and the area of its polygons inside the study area, the union of the polygons of ``study``; regions outside have none."""
    own, group = grouped(regions, [region], rings)
    parts = square_parts(own, study.select(rings), "intersection", group, float(size), rings, outline=False)
    return named(square_areas(parts, group), regions, [region]).groupBy(region).agg(F.sum("area").alias("area"))


def faces(lines: DataFrame, size: float = 1000.0) -> DataFrame:
    """Polygons that lines (x0, y0, x1, y1) enclose: part, area, rings (shell, then the holes that other lines cut out).

    Lines meet in their ends only (``planarize`` cuts them there), and repeated ones count once.  Every line is followed both ways; one that
    has the same area on both sides bounds none and is left out.  What lies inside a ring of a group of lines is a polygon, the outline of
    the whole group a hole of what is around it.
    """
    p, q = F.struct(F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y")), F.struct(F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"))
    own = lines.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")).filter("a != b").distinct()

    def both(d: DataFrame) -> DataFrame:
        ways = F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("e")), F.struct(F.col("b").alias("s"), F.col("a").alias("e"))))
        return d.select("a", "b", ways.alias("w")).select("a", "b", "w.s", "w.e")

    half = cut(both(own).withColumn("id", F.monotonically_increasing_id()))
    turned = half.select("id", "s", F.col("e").alias("s1"), "e", F.col("s").alias("e1"))
    sides = half.join(ring_order(next_lines(turned, [])), "id").groupBy("a", "b").agg(F.min("ring").alias("r0"), F.max("ring").alias("r1"))
    edges = cut(both(sides.filter("r0 != r1")))
    points = F.array(F.struct(F.col("s.x").alias("x"), F.col("s.y").alias("y"), F.xxhash64("s", "e").alias("edge")), F.struct(F.col("e.x").alias("x"), F.col("e.y").alias("y"), F.lit(0).cast("long").alias("edge")))
    paths = edges.select(points.cast(POINTS).alias("points"))
    return assemble(rings_of(paths, paths.limit(0), []), [], float(size)).select("part", "area", "rings")
