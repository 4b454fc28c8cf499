"""Overlay of general polygons with the lattice: rings are clipped to each cell they touch.

Cells come from a ring's bounds by row generation, as for rectangles; the clip of one ring against one cell is a small NumPy function
that runs on Arrow batches.  Clipping a ring that isn't convex against a rectangle may leave edges that run along the border twice;
they have no area, so areas are exact.  Holes count negative.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"


def ring_area(ring: np.ndarray) -> float:
    """Signed area of a ring of points (closed or not)."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def clip_half(ring: np.ndarray, axis: int, bound: float, keep_above: bool) -> np.ndarray:
    """The part of a ring on one side of an axis-parallel line."""
    if not len(ring):
        return ring
    d = ring[:, axis] - bound if keep_above else bound - ring[:, axis]
    after, d_after = np.roll(ring, -1, axis=0), np.roll(d, -1)
    crosses = (d > 0) & (d_after < 0) | (d < 0) & (d_after > 0)
    t = np.divide(d, d - d_after, out=np.zeros_like(d), where=crosses)
    met = ring + t[:, None] * (after - ring)
    met[:, axis] = np.where(crosses, bound, met[:, axis])
    both = np.stack([ring, met], axis=1).reshape(-1, 2)
    return both[np.stack([d >= 0, crosses], axis=1).ravel()]


def clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    for axis, bound, above in ((0, box[0], True), (0, box[2], False), (1, box[1], True), (1, box[3], False)):
        ring = clip_half(ring, axis, bound, above)
    return ring


def circle(x: float, y: float, radius: float, quadrant: int = 24) -> np.ndarray:
    """A circle as a polygon of 4 * quadrant corners."""
    a = 2 * np.pi * np.arange(4 * quadrant) / (4 * quadrant)
    return np.stack([x + radius * np.cos(a), y + radius * np.sin(a)], axis=1)


def wkb_polygons(blob: bytes) -> list[list[list[tuple[float, float]]]]:
    """Rings of each polygon of a WKB polygon, multipolygon or collection; other kinds give none."""
    out: list = []

    def read(at: int) -> int:
        e = "<" if blob[at] else ">"
        kind, n = struct.unpack_from(e + "II", blob, at + 1)
        at += 9
        width = 2 + (kind // 1000 in (1, 3) or bool(kind & 0x80000000)) + (kind // 1000 in (2, 3) or bool(kind & 0x40000000))
        kind = kind & 0xFF if kind & 0xE0000000 else kind % 1000
        if kind == 3:
            rings = []
            for _ in range(n):
                (k,) = struct.unpack_from(e + "I", blob, at)
                flat = struct.unpack_from(f"{e}{k * width}d", blob, at + 4)
                rings.append([(flat[i], flat[i + 1]) for i in range(0, k * width, width)])
                at += 4 + 8 * k * width
            out.append(rings)
        elif kind in (4, 5, 6, 7):
            for _ in range(n):
                at = read(at)
        elif kind == 2:
            at += 8 * n * width
        elif kind == 1:
            at += 8 * width - 4
        return at

    read(0)
    return out


def _over_zero(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Mean of the positive part of what runs evenly from p to q."""
    low, high = np.minimum(p, q), np.maximum(p, q)
    part = np.divide(high * high, 2 * (high - low), out=np.zeros_like(high), where=(low < 0) & (high > 0))
    return np.where(low >= 0, (p + q) / 2, part)


def boxed_areas(x: np.ndarray, y: np.ndarray, ring: np.ndarray, rings: int, x0: np.ndarray, y0: np.ndarray, size: float) -> np.ndarray:
    """Area of each ring inside its square of ``size`` at (x0, y0); x and y are the rings' corners one after another, ring their numbers.

    What lies under an edge and above the square's lower side, within its left and right ones, is a mean height times a width.
    """
    last = np.append(ring[1:] != ring[:-1], True)[: len(ring)]
    first = np.append(True, last[:-1])[: len(ring)]
    after = np.arange(len(ring)) + 1
    after[last] = np.flatnonzero(first)
    left, base = x0[ring], y0[ring]
    ax, ay, dx = x - left, y - base, x[after] - x
    dy = y[after] - y
    p, q = np.clip(ax, 0.0, size), np.clip(ax + dx, 0.0, size)
    slope = np.divide(dy, dx, out=np.zeros_like(dx), where=dx != 0)
    hp, hq = ay + (p - ax) * slope, ay + (q - ax) * slope
    height = _over_zero(hp, hq) - _over_zero(hp - size, hq - size)
    return np.abs(np.bincount(ring, np.where(dx != 0, (q - p) * height, 0.0), rings))


def _pieces(size: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_row = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            each = batch.column(1).flatten()
            corners = each.flatten()
            row = np.repeat(np.arange(batch.num_rows), per_row)
            ring = np.repeat(np.arange(len(each)), each.value_lengths().to_numpy(zero_copy_only=False))
            x0, y0 = (batch.column(k).to_numpy()[row] * size for k in (3, 2))
            x, y = (corners.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = boxed_areas(x, y, ring, len(each), x0, y0, size)
            shell = np.append(True, row[1:] != row[:-1])[: len(row)]
            areas = np.maximum(np.bincount(row, np.where(shell, found, -found), batch.num_rows), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(areas, pa.float64())], names=["id", "row_id", "col_id", "area"])

    return run


def polygon_overlay(df: DataFrame, size: int, rows: int, cols: int, key: str = "id", rings: str = "rings") -> DataFrame:
    """A row per polygon (``rings``: shell, then holes) and cell that share an area, with that area."""

    def bound(axis: str, f) -> Column:
        return f(F.transform(F.col("rings")[0], lambda p: p[axis]))

    def cells(axis: str, n: int) -> Column:
        first, last = F.greatest(F.floor(bound(axis, F.array_min) / size), F.lit(0)).cast("long"), F.least(F.floor(bound(axis, F.array_max) / size), F.lit(n - 1)).cast("long")
        return F.when(first <= last, F.sequence(first, last))

    own = df.select(F.col(key).alias("id"), F.col(rings).cast(RINGS).alias("rings")).filter(F.size("rings") > 0)
    spread = own.withColumn("row_id", F.explode(cells("y", rows))).withColumn("col_id", F.explode(cells("x", cols)))
    kind = df.schema[key].dataType.simpleString()
    out = spread.select("id", "rings", "row_id", "col_id").mapInArrow(_pieces(float(size)), f"id {kind}, row_id long, col_id long, area double")
    return out.filter("area > 0").withColumnRenamed("id", key)
