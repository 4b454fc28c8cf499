"""Unions, differences and intersections of polygons inside a box, by a sweep over slabs.

The box is cut at every corner and every crossing of two edges; inside a slab edges keep their order, so what is covered is a list of
trapezoids between edges.  One sweep gives the union's area, what it leaves open and which open pieces hang together, and the parts of
other polygons and of their outlines that lie inside.  A group is what touches one square of the lattice; callers choose squares small
enough.  Many squares are swept together, as arrays of all their edges and slabs; a square of many edges goes through several blocks of
slabs, so memory grows with its edges, not with their square.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import components
from .polygons import RINGS
from .ranking import cut, few

Box = tuple[float, float, float, float]
EPS = 1e-9
#: Rows of edges and slabs, or of two edges, that are looked at together.
BLOCK = 1 << 19


def _ranges(start: np.ndarray, number: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, ``number`` values each, one after another."""
    return np.repeat(start - np.cumsum(number) + number, number) + np.arange(int(number.sum()))


def _blocks(number: np.ndarray) -> Iterator[slice]:
    """Stretches of rows that make BLOCK pairs together, or one row of more."""
    total, lo = np.cumsum(number), 0
    while lo < len(number):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK, side="right")))
        yield slice(lo, hi)
        lo = hi


@dataclass
class Shapes:
    """Rings of many boxes' polygons: corners one after another, the ring of each, the polygon of each ring, box and layer of each polygon."""

    corners: np.ndarray
    ring: np.ndarray
    polygon: np.ndarray
    box: np.ndarray
    layer: np.ndarray

    def __add__(self, other: Shapes) -> Shapes:
        both = ((self.corners, other.corners), (self.ring, other.ring + len(self.polygon)), (self.polygon, other.polygon + len(self.box)), (self.box, other.box), (self.layer, other.layer))
        return Shapes(*(np.concatenate(p) for p in both))


def shapes_of(polygons: list[list[np.ndarray]], layer: int = 0, box: int = 0) -> Shapes:
    """Polygons, as lists of rings, of one box."""
    rings = [np.asarray(r, float).reshape(-1, 2) for rings in polygons for r in rings]
    return Shapes(
        np.concatenate([np.zeros((0, 2)), *rings]), np.repeat(np.arange(len(rings)), [len(r) for r in rings]).astype(int),
        np.repeat(np.arange(len(polygons)), [len(r) for r in polygons]).astype(int), np.full(len(polygons), box), np.full(len(polygons), layer),
    )


def _following(ring: np.ndarray) -> np.ndarray:
    """The place of each corner's next one."""
    first = np.flatnonzero(np.append(True, ring[1:] != ring[:-1])[: len(ring)])
    after = np.arange(1, len(ring) + 1)
    after[np.append(first[1:], len(ring))[: len(first)] - 1] = first
    return after


def _clipped(p: np.ndarray, ring: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rings clipped to their boxes (bounds: a row per ring), like ``clip_ring``."""
    for axis, side, above in ((0, 0, True), (0, 2, False), (1, 1, True), (1, 3, False)):
        bound = bounds[ring, side]
        d = p[:, axis] - bound if above else bound - p[:, axis]
        after = _following(ring)
        d_after = d[after]
        crosses = (d > 0) & (d_after < 0) | (d < 0) & (d_after > 0)
        t = np.divide(d, d - d_after, out=np.zeros_like(d), where=crosses)
        met = p + t[:, None] * (p[after] - p)
        met[:, axis] = np.where(crosses, bound, met[:, axis])
        keep = np.stack([d >= 0, crosses], axis=1).ravel()
        p, ring = np.stack([p, met], axis=1).reshape(-1, 2)[keep], np.repeat(ring, 2)[keep]
    return p, ring


@dataclass
class Edges:
    """Edges that rise (x0, y0 is the lower end) in order of box and lower end, with box, polygon and layer of each; and level ones: from, to,
    height, box and polygon."""

    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    box: np.ndarray
    polygon: np.ndarray
    layer: np.ndarray
    flat: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]

    def at(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.x0[rows] + (y - self.y0[rows]) * (self.x1[rows] - self.x0[rows]) / (self.y1[rows] - self.y0[rows])


def edges_of(shapes: Shapes, boxes: np.ndarray) -> Edges:
    """Edges of the polygons, clipped to their boxes (a row of four bounds each)."""
    p, ring = _clipped(shapes.corners, shapes.ring, boxes[shapes.box[shapes.polygon]])
    q, polygon = p[_following(ring)], shapes.polygon[ring]
    level = p[:, 1] == q[:, 1]
    flat = (np.minimum(p[level, 0], q[level, 0]), np.maximum(p[level, 0], q[level, 0]), p[level, 1], shapes.box[polygon[level]], polygon[level])
    up = (p[:, 1] < q[:, 1])[:, None]
    low, high, polygon = np.where(up, p, q)[~level], np.where(up, q, p)[~level], polygon[~level]
    order = np.lexsort((low[:, 1], shapes.box[polygon]))
    low, high, polygon = low[order], high[order], polygon[order]
    return Edges(*low.T, *high.T, shapes.box[polygon], polygon, shapes.layer[polygon], flat)


def _key(box: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Box and height as one number; complex ones are ordered by the real part first."""
    return box + 1j * y


def crossings(e: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Boxes and heights in which two edges cross."""
    dx, dy = e.x1 - e.x0, e.y1 - e.y0
    left, right = np.minimum(e.x0, e.x1), np.maximum(e.x0, e.x1)
    # Edges that begin below an edge's end, of those after it.
    number = np.maximum(np.searchsorted(_key(e.box, e.y0), _key(e.box, e.y1)) - np.arange(len(dx)) - 1, 0)
    boxes, found = [np.zeros(0, int)], [np.zeros(0)]
    for s in _blocks(number):
        i = np.repeat(np.arange(s.start, s.stop), number[s])
        j = _ranges(np.arange(s.start, s.stop) + 1, number[s])
        near = (left[i] <= right[j]) & (right[i] >= left[j])
        i, j = i[near], j[near]
        turn = dx[i] * dy[j] - dy[i] * dx[j]
        i, j, turn = i[turn != 0], j[turn != 0], turn[turn != 0]
        qx, qy = e.x0[j] - e.x0[i], e.y0[j] - e.y0[i]
        t, u = (qx * dy[j] - qy * dx[j]) / turn, (qx * dy[i] - qy * dx[i]) / turn
        on = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        boxes.append(e.box[i[on]])
        found.append(e.y0[i[on]] + t[on] * dy[i[on]])
    return np.concatenate(boxes), np.concatenate(found)


@dataclass
class Slabs:
    """Slabs (box, low, high) from number ``first`` on; their edges from left to right, with the slab of each (from 0), its x at both heights
    and, for each layer, whether it covers what follows; and the stretches that layer 0 covers, as places of their first and last edges."""

    first: int
    box: np.ndarray
    low: np.ndarray
    high: np.ndarray
    slab: np.ndarray
    rows: np.ndarray
    bottom: np.ndarray
    top: np.ndarray
    covers: np.ndarray  # layers x edges
    begin: np.ndarray
    end: np.ndarray

    def areas(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        width = (self.bottom[b] - self.bottom[a] + self.top[b] - self.top[a]) / 2
        return np.maximum(0.0, width * (self.high - self.low)[self.slab[a]])

    def covered(self, boxes: int) -> np.ndarray:
        return np.bincount(self.box[self.slab[self.begin]], self.areas(self.begin, self.end), boxes)


def sweep(e: Edges, boxes: np.ndarray, layers: int) -> Iterator[Slabs]:
    """The slabs of all boxes, in blocks of bounded size: a large box takes several."""
    n = np.arange(len(boxes))
    box, y = (np.concatenate(p) for p in zip((e.box, e.y0), (e.box, e.y1), crossings(e), (e.flat[3], e.flat[2]), (n, boxes[:, 1]), (n, boxes[:, 3]), strict=True))
    within = (y >= boxes[box, 1]) & (y <= boxes[box, 3])
    box, y = box[within], y[within]
    order = np.lexsort((y, box))
    box, y = box[order], y[order]
    new = np.append(True, (box[1:] != box[:-1]) | (np.diff(y) > EPS))[: len(y)]
    box, y = box[new], y[new]
    same = np.flatnonzero(box[1:] == box[:-1])
    box, low, high = box[same], y[same], y[same + 1]
    middle = (low + high) / 2
    key = _key(box, middle)
    start, stop = np.searchsorted(key, _key(e.box, e.y0), side="right"), np.searchsorted(key, _key(e.box, e.y1))
    active = np.cumsum(np.bincount(start, minlength=len(box) + 1) - np.bincount(stop, minlength=len(box) + 1))[: len(box)]
    for s in _blocks(active + 1):
        rows = np.flatnonzero((start < s.stop) & (stop > s.start))
        begin = np.maximum(start[rows], s.start)
        number = np.maximum(np.minimum(stop[rows], s.stop) - begin, 0)
        slab, rows = _ranges(begin, number), np.repeat(rows, number)
        order = np.lexsort((e.at(rows, middle[slab]), slab))
        slab, rows = slab[order], rows[order]
        # Of a polygon's edges from left to right every other one enters it.
        by = np.lexsort((e.polygon[rows], slab))
        same = np.append(True, (slab[by][1:] != slab[by][:-1]) | (e.polygon[rows][by][1:] != e.polygon[rows][by][:-1]))[: len(by)]
        place = np.arange(len(by))
        enters = np.zeros(len(rows), int)
        enters[by] = np.where((place - np.maximum.accumulate(np.where(same, place, 0))) % 2 == 0, 1, -1)
        head = np.append(True, slab[1:] != slab[:-1])[: len(slab)]
        covers = []
        for k in range(layers):
            step = np.where(e.layer[rows] == k, enters, 0)
            depth = np.cumsum(step)
            before = depth - step
            covers.append(depth > before[np.maximum.accumulate(np.where(head, place, 0))])
        c = covers[0]
        turns = np.flatnonzero(c != (np.append(False, c[:-1])[: len(c)] & ~head))
        a, b = turns[:-1], turns[1:]
        span = c[a] & (slab[a] == slab[b])
        yield Slabs(s.start, box[s], low[s], high[s], slab - s.start, rows, e.at(rows, low[slab]), e.at(rows, high[slab]), np.stack(covers), a[span], b[span])


def union_area(polygons: list[list[np.ndarray]], box: Box) -> float:
    boxes = np.array([box])
    return float(sum(s.covered(1)[0] for s in sweep(edges_of(shapes_of(polygons), boxes), boxes, 1)))


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 to n - 1 that each hangs together with, by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(step := new[new], new):
            new = step
        if np.array_equal(new, root):
            return root
        root = new


def open_parts(shapes: Shapes, boxes: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]:
    """Covered area of each box; box and area of each open piece; and where pieces touch the sides of their boxes: side (w, e, s or n), from, to, piece."""
    covered, found = np.zeros(len(boxes)), []
    for s in sweep(edges_of(shapes, boxes), boxes, 1):
        covered += s.covered(len(boxes))
        # A gap before each covered stretch and one behind the last, or the slab's whole width.
        number = np.bincount(s.slab[s.begin], minlength=len(s.box)) + 1
        slab = np.repeat(np.arange(len(s.box)), number)
        head = np.append(True, slab[1:] != slab[:-1])[: len(slab)]
        tail = np.append(head[1:], True)[: len(slab)]
        left, right = np.stack([boxes[s.box[slab], 0]] * 2), np.stack([boxes[s.box[slab], 2]] * 2)
        left[:, ~head], right[:, ~tail] = (s.bottom[s.end], s.top[s.end]), (s.bottom[s.begin], s.top[s.begin])
        size = (right[0] - left[0] + right[1] - left[1]) / 2 * (s.high - s.low)[slab]
        keep = size > EPS * EPS
        found.append([x[keep] for x in (slab + s.first, s.box[slab], size, *left, *right, s.low[slab], s.high[slab])])
    slab, box, size, bl, tl, br, tr, low, high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),) * 7
    # Gaps of the slab below, in order: those that end right of a gap's left and begin left of its right.
    ends, begins = (_key(slab, x) for x in (tr, tl))
    first, last = np.searchsorted(ends, _key(slab - 1, bl)), np.searchsorted(begins, _key(slab - 1, br), side="right")
    number = np.maximum(last - first, 0)
    now, before = np.repeat(np.arange(len(slab)), number), _ranges(first, number)
    near = (slab[before] == slab[now] - 1) & (box[before] == box[now]) & (np.minimum(tr[before], br[now]) - np.maximum(tl[before], bl[now]) > EPS)
    names, piece = np.unique(_roots(before[near], now[near], len(slab)), return_inverse=True)
    west, south, east, north = boxes[box].T
    at = ((bl == west) & (tl == west), (br == east) & (tr == east), low <= south, high >= north)
    sides = [(np.full(int(k.sum()), side), a[k], b[k], piece[k]) for side, k, a, b in zip("wesn", at, (low, low, bl, tl), (high, high, br, tr), strict=True)]
    side, a, b, owner = (np.concatenate(x) for x in zip(*sides, strict=True))
    wide = b - a > EPS
    return covered, (box[names], np.bincount(piece, size, len(names))), (side[wide], a[wide], b[wide], owner[wide])


def open_pieces(polygons: list[list[np.ndarray]], box: Box) -> tuple[float, np.ndarray, list[tuple[str, float, float, int]]]:
    """Covered area of one box, the areas of the open pieces, and where they touch the box's sides: side, from, to, piece."""
    covered, (_, areas), sides = open_parts(shapes_of(polygons), np.array([box], float))
    return float(covered[0]), areas, list(zip(*(x.tolist() for x in sides), strict=True))


def parts_inside(shapes: Shapes, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Area of the union of each box's polygons of layer 0, and for each polygon (of layer 1) its area and the length of its outline inside
    that union.

    Outlines are taken as they are in the box; where one runs along the box's side only because it was cut there, it doesn't count.
    """
    e = edges_of(shapes, boxes)
    whole, area, length = np.zeros(len(boxes)), np.zeros(len(shapes.box)), np.zeros(len(shapes.box))
    fx0, fx1, fy, f_box, f_polygon = e.flat
    lying = (shapes.layer[f_polygon] == 1) & (fy > boxes[f_box, 1]) & (fy < boxes[f_box, 3])
    fx0, fx1, fy, f_box, f_polygon = (x[lying] for x in (fx0, fx1, fy, f_box, f_polygon))
    f_key = _key(f_box, fy)
    beside = np.zeros((2, len(fy)))
    for s in sweep(e, boxes, 2):
        whole += s.covered(len(boxes))
        polygon, other = e.polygon[s.rows], e.layer[s.rows] == 1
        on_side = (s.bottom == s.top) & ((s.bottom == boxes[s.box[s.slab], 0]) | (s.bottom == boxes[s.box[s.slab], 2]))
        seen = np.flatnonzero(other & s.covers[0] & ~on_side)
        length += np.bincount(polygon[seen], np.hypot(s.top[seen] - s.bottom[seen], (s.high - s.low)[s.slab[seen]]), len(length))
        # Covered area between an edge and the next one, added up from where a polygon is entered to where it is left.
        between = np.zeros(len(s.rows) + 1)
        a = _ranges(s.begin, s.end - s.begin)
        between[a] = s.areas(a, a + 1)
        own = np.flatnonzero(other)
        own = own[np.lexsort((polygon[own], s.slab[own]))]
        new = np.append(True, (s.slab[own][1:] != s.slab[own][:-1]) | (polygon[own][1:] != polygon[own][:-1]))[: len(own)]
        place = np.arange(len(own))
        odd = (place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 1
        leave = np.flatnonzero(odd)
        if len(leave):
            ends = np.stack([own[leave - 1], own[leave]], axis=1).ravel()
            area += np.bincount(polygon[own[leave]], np.add.reduceat(between, ends)[::2], len(area))
        # Level edges: what is covered in the slabs below and above them, where those touch.
        of_span = s.slab[s.begin]
        for k, (y, x) in enumerate(((s.high, s.top), (s.low, s.bottom))):
            key = _key(s.box, y)
            slab = np.minimum(np.searchsorted(key, f_key), len(key) - 1)
            f = np.flatnonzero(key[slab] == f_key)
            start, stop = np.searchsorted(of_span, slab[f]), np.searchsorted(of_span, slab[f], side="right")
            g, span = np.repeat(f, stop - start), _ranges(start, stop - start)
            held = np.maximum(0.0, np.minimum(fx1[g], x[s.end[span]]) - np.maximum(fx0[g], x[s.begin[span]]))
            beside[k] += np.bincount(g, held, len(fy))
    length += np.bincount(f_polygon, beside.max(axis=0), len(length))
    return whole, area, length


def inside(cover: list[list[np.ndarray]], others: list[list[np.ndarray]], box: Box) -> tuple[float, np.ndarray, np.ndarray]:
    """``parts_inside`` of one box: area of the union of ``cover``, and areas and lengths of the other polygons."""
    whole, area, length = parts_inside(shapes_of(cover) + shapes_of(others, 1), np.array([box], float))
    return float(whole[0]), area[len(cover) :], length[len(cover) :]


def capsules(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, radius: float, quadrant: int = 8) -> np.ndarray:
    """Segments' surroundings within radius, a row of corners each, their round ends as ``quadrant`` chords a quarter circle."""
    turn = np.arctan2(y1 - y0, x1 - x0)
    a = (turn - np.pi / 2)[:, None] + np.pi * np.arange(2 * quadrant + 1) / (2 * quadrant)
    arc = radius * np.stack([np.cos(a), np.sin(a)], axis=2)
    return np.concatenate([np.stack([x1, y1], axis=1)[:, None] + arc, np.stack([x0, y0], axis=1)[:, None] - arc], axis=1)


def capsule(x0: float, y0: float, x1: float, y1: float, radius: float, quadrant: int = 8) -> np.ndarray:
    return capsules(*(np.array([v], float) for v in (x0, y0, x1, y1)), radius, quadrant)[0]


def _row_shapes(rings: pa.Array, box: np.ndarray, layer: int = 0) -> Shapes:
    """Shapes of a column of rings without nulls; box: that of each row."""
    each = rings.flatten()
    corners = each.flatten()
    sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(int) for x in (rings, each)]
    xy = np.stack([corners.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1).astype(float)
    return Shapes(xy.reshape(-1, 2), np.repeat(np.arange(len(each)), sizes[1]), np.repeat(np.arange(len(rings)), sizes[0]), box, np.full(len(rings), layer))


def _boxed(keys: int, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by their first ``keys`` columns (whole numbers): ``work`` on whole groups, some thousands of rows together, with the
    keys of each group and each row's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def take(rows: pa.Table, values: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (values[1:] != values[:-1]).any(axis=1))
            return work(rows.combine_chunks().to_batches()[0], values[new], np.cumsum(new) - 1)

        def named(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
            return np.stack([rows.column(k).to_numpy() for k in range(keys)], axis=1)

        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                last = named(batch)[-1]
                kept.append(batch)
                if (named(kept[0])[0] == last).all():
                    continue
                rows = pa.Table.from_batches(kept)
                values = named(rows)
                size = int(np.flatnonzero((values != last).any(axis=1))[-1]) + 1
                yield take(rows.slice(0, size), values[:size])
                kept = rows.slice(size).to_batches()
        if kept:
            rows = pa.Table.from_batches(kept)
            yield take(rows, named(rows))

    return run


def touched_cells(df: DataFrame, size: float, rings: str = "rings") -> DataFrame:
    """A row per polygon and lattice cell that its bounds touch: row_id and col_id join the columns."""
    corners = F.col(rings).cast(RINGS)[0]

    def cells(axis: str):
        values = F.transform(corners, lambda c: c[axis])
        return F.explode(F.sequence(F.floor(F.array_min(values) / size).cast("long"), F.floor(F.array_max(values) / size).cast("long")))

    return df.filter(F.size(rings) > 0).withColumn("row_id", cells("y")).withColumn("col_id", cells("x"))


def open_space(pieces: DataFrame, size: int, min_patch: float = 25.0, crowd: int = 300, parts: int = 8) -> DataFrame:
    """Union area of the polygons of a cell (row_id, col_id, and rings or a rectangle x0, y0, x1, y1), and its open patches of ``min_patch``
    or more: count, area, largest, and fragmentation n * (1 - largest / open).

    A cell of more than ``crowd`` polygons is swept in parts * parts squares, so it is many tasks' work; pieces of neighbouring squares that
    share a stretch of border are one patch, found by components over the borders.
    """
    own = pieces
    if "rings" not in pieces.columns:
        corners = F.array(*[F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
        own = pieces.withColumn("rings", F.array(corners))
    own = own.select("row_id", "col_id", F.col("rings").cast(RINGS).alias("rings"))
    cells = own.groupBy("row_id", "col_id").agg(F.when(F.count(F.lit(1)) > crowd, parts).otherwise(1).cast("long").alias("parts"))
    # Polygons are never the side of a join that travels whole, however small Spark takes them to be before they are exploded.
    cells = few(cells)
    own = own.join(cells, ["row_id", "col_id"])
    step = size / F.col("parts")

    def bound(axis: str, f):
        return f(F.transform(F.col("rings")[0], lambda p: p[axis]))

    def squares(axis: str, cell: str):
        first = F.greatest(F.floor((bound(axis, F.array_min) - F.col(cell) * size) / step), F.lit(0))
        last = F.least(F.floor((bound(axis, F.array_max) - F.col(cell) * size) / step), F.col("parts") - 1)
        return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))

    spread = own.withColumn("r", F.explode(squares("y", "row_id"))).withColumn("c", F.explode(squares("x", "col_id")))
    steps = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    every = cells.withColumn("r", F.explode(steps)).withColumn("c", F.explode(steps)).withColumn("rings", F.lit(None).cast(RINGS))
    whole = spread.unionByName(every)

    def work(rows: pa.RecordBatch, keys: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        row, col, r, c, n = keys.T
        step = size / n
        x, y = col * size + c * step, row * size + r * step
        held = rows.column(5).is_valid()
        covered, (box, areas), (side, a, b, piece) = open_parts(_row_shapes(rows.column(5).filter(held), group[held.to_numpy(zero_copy_only=False)]), np.stack([x, y, x + step, y + step], axis=1))
        number = np.arange(len(box)) - np.searchsorted(box, box)
        # Borders matter between the squares of a cell.
        split = n[box[piece]] > 1
        side, a, b, piece = side[split], a[split], b[split], piece[split]
        of = np.concatenate([box, box[piece], np.arange(len(keys))])
        none, zero = np.zeros(len(box)), np.zeros(len(keys))
        sides = pa.array([*[None] * len(box), *side.tolist(), *[None] * len(keys)], pa.string())
        columns = [*(pa.array(k[of]) for k in (row, col, r, c)), pa.array(np.concatenate([number, number[piece], np.full(len(keys), -1)])), pa.array(np.concatenate([areas, np.zeros(len(piece)), covered])), sides, *(pa.array(np.concatenate([none, v, zero])) for v in (a, b))]
        return pa.RecordBatch.from_arrays(columns, names=["row_id", "col_id", "r", "c", "piece", "area", "side", "a", "b"])

    square = ["row_id", "col_id", "r", "c"]
    dealt = whole.select(*[F.col(k).cast("long").alias(k) for k in square], F.col("parts").cast("long").alias("parts"), "rings").repartition(*square).sortWithinPartitions(*square)
    found = cut(dealt.mapInArrow(_boxed(5, work), "row_id long, col_id long, r long, c long, piece long, area double, side string, a double, b double"))
    named = found.withColumn("id", F.xxhash64("row_id", "col_id", "r", "c", "piece"))
    border = named.filter("side IS NOT NULL")
    near = border.select("row_id", "col_id", "r", "c", "side", "a", "b", "id")
    ahead = near.filter("side IN ('n', 'e')").select("row_id", "col_id", (F.col("r") + (F.col("side") == "n").cast("int")).alias("r"), (F.col("c") + (F.col("side") == "e").cast("int")).alias("c"), F.when(F.col("side") == "n", "s").otherwise("w").alias("side"), F.col("a").alias("oa"), F.col("b").alias("ob"), F.col("id").alias("other"))
    links = near.join(ahead.hint("merge"), ["row_id", "col_id", "r", "c", "side"]).filter(F.least("b", "ob") - F.greatest("a", "oa") > EPS).select(F.col("id").alias("a"), F.col("other").alias("b"))
    roots = components(links)
    sizes = named.filter("piece >= 0 AND side IS NULL").join(roots.hint("merge"), F.col("id") == F.col("node"), "left").groupBy("row_id", "col_id", F.coalesce("root", "id").alias("patch")).agg(F.sum("area").alias("area")).filter(F.col("area") >= min_patch)
    patches = sizes.groupBy("row_id", "col_id").agg(F.sum("area").alias("open_area"), F.count(F.lit(1)).alias("open_patches"), F.max("area").alias("largest_patch"))
    union = named.filter("piece < 0").groupBy("row_id", "col_id").agg(F.sum("area").alias("union_area"))
    out = union.join(patches, ["row_id", "col_id"], "left").fillna(0.0, ["open_area", "largest_patch"]).fillna(0, ["open_patches"])
    return out.select("row_id", "col_id", "union_area", "open_area", "open_patches", "largest_patch", F.when(F.col("open_area") > 0, F.col("open_patches") * (1 - F.col("largest_patch") / F.col("open_area"))).alias("fragmentation"))


def frontage_context(roads: DataFrame, buildings: DataFrame, size: float, radius: float = 20.0, quadrant: int = 8) -> DataFrame:
    """Per cell with a road: road_length, buffer_area (the union of the surroundings of its road pieces, inside the cell), and the buildings
    in it: building_count, building_area and edge_length (their outlines inside it).

    roads: row_id, col_id, length and the piece's ends px0, py0, px1, py1; buildings: row_id, col_id and rings.
    """
    r = roads.select("row_id", "col_id", F.lit(0).alias("kind"), "length", *[F.col(c).cast("double").alias(c) for c in ("px0", "py0", "px1", "py1")], F.lit(None).cast(RINGS).alias("rings"))
    b = buildings.join(roads.select("row_id", "col_id").distinct(), ["row_id", "col_id"], "left_semi").select("row_id", "col_id", F.lit(1).alias("kind"), F.lit(0.0).alias("length"), *[F.lit(None).cast("double").alias(c) for c in ("px0", "py0", "px1", "py1")], F.col("rings").cast(RINGS).alias("rings"))

    def work(rows: pa.RecordBatch, keys: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        row, col = keys.T
        road = rows.column(2).to_numpy() == 0
        ends = [rows.column(k).to_numpy(zero_copy_only=False)[road] for k in range(4, 8)]
        around = capsules(*ends, radius, quadrant)
        n, corners = around.shape[:2]
        one = np.arange(n)
        cover = Shapes(around.reshape(-1, 2), np.repeat(one, corners), one, group[road], np.zeros(n, int))
        others = _row_shapes(rows.column(8).filter(pa.array(~road)), group[~road], 1)
        whole, area, edge = parts_inside(cover + others, np.stack([col * size, row * size, (col + 1) * size, (row + 1) * size], axis=1))
        area, edge = area[n:], edge[n:]
        seen, g = area > 0, len(keys)
        sums = [np.bincount(others.box[seen], v, g) for v in (None, area[seen], edge[seen])]
        lengths = np.bincount(group[road], rows.column(3).to_numpy()[road], g)
        kinds = [pa.int64()] * 2 + [pa.float64()] * 2 + [pa.int64()] + [pa.float64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((row, col, lengths, whole, *sums), kinds, strict=True)], names=["row_id", "col_id", "road_length", "buffer_area", "building_count", "building_area", "edge_length"])

    cell = ["row_id", "col_id"]
    dealt = r.unionByName(b).repartition(*cell).sortWithinPartitions(*cell)
    return dealt.mapInArrow(_boxed(2, work), "row_id long, col_id long, road_length double, buffer_area double, building_count long, building_area double, edge_length double")
