"""Polygon booleans against rasters, faces against Euler's formula, mended rings, points against crossing counts, pairs that a point meets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import network, overlay, squares

from .test_geometry import held, raster, shapes

RINGS = "array<array<struct<x:double,y:double>>>"


def table(spark, polygons, key=lambda k: 0):
    return spark.createDataFrame([(key(k), [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]) for k, p in enumerate(polygons)], f"k int, rings {RINGS}")


def points_of(ring):
    return np.array([(p.x, p.y) for p in ring])


def area(ring):
    x, y = points_of(ring).T
    return float(np.dot(x - x[0], np.roll(y, -1) - y[0]) - np.dot(np.roll(x, -1) - x[0], y - y[0])) / 2


def mask(rings, x, y):
    out = np.zeros(x.shape, bool)
    for r in rings:
        out ^= held(r, x, y)
    return out


def is_valid(rows):
    for r in rows:
        sizes = [area(ring) for ring in r.rings]
        assert sizes[0] > 0 and all(s < 0 for s in sizes[1:]) and sum(sizes) == pytest.approx(r.area, abs=1e-6)
        for ring in r.rings:
            p = points_of(ring)
            assert (p != np.roll(p, -1, axis=0)).any(axis=1).all()


@pytest.mark.parametrize(("seed", "how", "size"), [(0, "union", 20.0), (1, "intersection", 7.0), (2, "difference", 33.0), (3, "union", 500.0)])
def test_booleans_against_rasters(spark, seed, how, size):
    rng = random.Random(seed)
    a, b = shapes(rng, 8), shapes(rng, 5)
    x, y = (2 * g - 50 for g in raster(700))
    one, two = (np.any([held(r, x, y) for (r,) in p], axis=0) for p in (a, b))
    want = {"union": one | two, "intersection": one & two, "difference": one & ~two}[how]
    rows = overlay.overlay(table(spark, a), table(spark, b).select("rings"), how, [], size).collect()
    got = mask([points_of(ring) for r in rows for ring in r.rings], x, y)
    assert (got != want).sum() == 0
    is_valid(rows)
    parts = overlay.square_parts(table(spark, a), table(spark, b).select("rings"), how, [], size, outline=False)
    assert overlay.square_areas(parts, []).agg(F.sum("area")).first()[0] == pytest.approx(sum(r.area for r in rows), abs=1e-3)


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_holes_islands_touching_and_lattice_lines(spark):
    """A frame with an island in its hole, squares that touch in a corner or share an edge, all on lattice lines; drawn both ways round."""
    frame = [square(0, 0, 100, 100), square(20, 20, 80, 80)[::-1]]
    island = [square(40, 40, 60, 60)[::-1]]
    corner, neighbour = [square(100, 100, 120, 120)], [square(100, 0, 130, 40)]
    again = [square(100, 0, 130, 40)[::-1]]
    rows = overlay.overlay(table(spark, [frame, island, corner, neighbour, again]), size=10.0).orderBy("part").collect()
    is_valid(rows)
    assert sorted((r.area, len(r.rings)) for r in rows) == [(400.0, 1), (400.0, 1), (7600.0, 2)]
    big = next(r for r in rows if r.area == 7600)
    assert {tuple(p) for p in points_of(big.rings[0]).tolist()} == {(0, 0), (130, 0), (130, 40), (100, 40), (100, 100), (0, 100)}
    assert {tuple(p) for p in points_of(big.rings[1]).tolist()} == set(square(20, 20, 80, 80))


def test_keys_empty_and_null(spark):
    df = table(spark, [[square(0, 0, 10, 10)], [square(5, 5, 15, 15)], [square(50, 50, 60, 60)], [], [[(0, 0), (1, 1)]]], key=lambda k: k % 2)
    df = df.unionByName(spark.createDataFrame([(None, None), (None, [[{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 9.0}]])], f"k int, rings {RINGS}"))
    got = {(r.k, r.part): r.area for r in overlay.overlay(df, keys=["k"], size=8.0).collect()}
    assert got == {(0, 1): 100.0, (0, 2): 100.0, (1, 1): 100.0, (None, 1): 40.5}
    cut = overlay.overlay(df, table(spark, [[square(0, 0, 5, 100)]]).select("rings"), "intersection", ["k"], 8.0)
    assert {(r.k, r.area) for r in cut.collect()} == {(0, 50.0), (None, 12.5)}
    assert overlay.overlay(df.limit(0), keys=["k"]).count() == 0


def test_mended_rings(spark):
    bow = [[(0, 0), (10, 10), (10, 0), (0, 10)]]
    star = [[(0, 30), (20, 30), (4, 42), (10, 22), (16, 42)]]
    rows = overlay.mended(table(spark, [bow, star], key=lambda k: k), ["k"], 7.0).collect()
    is_valid(rows)
    assert sorted(r.area for r in rows if r.k == 0) == pytest.approx([25, 25])
    x, y = raster(900)
    lobes = np.zeros(x.shape, int)
    p = np.array(star[0], float)
    for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, axis=0), strict=True):
        right = x < ax + (y - ay) * (bx - ax) / (by - ay) if ay != by else False
        lobes += np.where((ay <= y) & (by > y) & right, 1, 0) - np.where((ay > y) & (by <= y) & right, 1, 0)
    assert sum(r.area for r in rows if r.k == 1) == pytest.approx((lobes != 0).sum() * 1e4 / lobes.size, rel=0.01)


@pytest.mark.parametrize("seed", range(3))
def test_faces_follow_eulers_formula(spark, seed):
    rng = random.Random(seed)
    lines = [(k, *[float(rng.randint(0, 60)) for _ in range(4)]) for k in range(40)] + [(90, 200.0, 0.0, 210.0, 0.0), (91, 210.0, 0.0, 205.0, 9.0), (92, 205.0, 9.0, 200.0, 0.0), (93, 20.0, 20.0, 30.0, 20.0), (94, 20.0, 20.0, 30.0, 20.0)]
    parts = network.planarize(spark.createDataFrame(lines, "id long, x0 double, y0 double, x1 double, y1 double"), 2.0**-16, 25.0)
    edges = {tuple(sorted(((r.x0, r.y0), (r.x1, r.y1)))) for r in parts.collect()}
    nodes = {p for e in edges for p in e}
    root = {p: p for p in nodes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        root[find(a)] = find(b)
    groups = len({find(p) for p in nodes})
    rows = overlay.faces(parts, 25.0).collect()
    is_valid(rows)
    assert len(rows) == len(edges) - len(nodes) + groups
    x, y = raster(400)
    covered = sum(mask([points_of(ring) for ring in r.rings], x * 0.6, y * 0.6).astype(int) for r in rows)
    assert covered.max() <= 1


def test_a_group_of_lines_inside_a_face_is_its_hole(spark):
    frame, inner = square(0, 0, 100, 100), square(30, 30, 60, 60)
    lines = [(*a, *b) for ring in (frame, inner) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)] + [(30, 40, 60, 40), (100, 50, 140, 50), (80, 80, 90, 90)]
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(lines)], "id long, x0 double, y0 double, x1 double, y1 double")
    rows = overlay.faces(network.planarize(df, squares.GRAIN, 16.0), 16.0).collect()
    assert sorted((r.area, len(r.rings)) for r in rows) == [(300.0, 1), (600.0, 1), (9100.0, 2)]


def test_points_against_crossing_counts(spark):
    rng = random.Random(7)
    polygons = [*shapes(rng, 12), [square(0, 0, 64, 64), square(16, 16, 32, 32)], [[(64, 64), (80, 72), (64, 80), (72, 72)]]]
    polygons = [[np.round(np.array(r, float) * 4) / 4 for r in p] for p in polygons]
    points = [(k, rng.randint(-20, 130) / 1.0, rng.randint(-20, 130) / 1.0) for k in range(1500)] + [(5000 + k, *map(float, v)) for k, v in enumerate([(0, 0), (64, 64), (16, 20), (32, 16), (72, 72), (64, 80), (80, 72), (64, 10)])]
    x, y = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    want = set()
    for k, rings in enumerate(polygons):
        inside, on = mask(rings, x, y), np.zeros(len(x), bool)
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, np.roll(r, -1, axis=0), strict=True):
                on |= ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & (np.minimum(ax, bx) <= x) & (x <= np.maximum(ax, bx)) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by))
        want |= {(points[i][0], k, 0 if on[i] else 1) for i in np.flatnonzero(inside | on)}
    df = spark.createDataFrame(points, "id long, x double, y double")
    for size in (16.0, 5.0):
        got = squares.points_in_regions(df, "id", table(spark, polygons, key=lambda k: k), "k", size)
        assert {tuple(r) for r in got.collect()} == want


def test_points_meet_the_edges_of_their_square_only(spark):
    """A region 2,000 squares wide with an edge in each: a point meets a few edges, not all of its row."""
    n = 2000
    top = [(10.0 * k, 95.0 + k % 2) for k in range(n, -1, -1)]
    region = table(spark, [[[(0.0, 91.0), (10.0 * n, 91.0), *top]]])
    points = spark.range(500).select("id", (F.col("id") * 37.3).alias("x"), F.lit(93.0).alias("y"))
    parts = squares.square_edges(squares.oriented_edges(region.withColumnRenamed("k", "_region"), ["_region"], "rings", squares.GRAIN, True), 10.0, squares.GRAIN)
    own = points.select(F.col("id").alias("_key"), F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("y") / 10).cast("long").alias("row_id"), F.floor(F.col("x") / 10).cast("long").alias("col_id"))
    assert squares.point_meetings(own, parts, 10.0).count() <= 4 * 500
    assert squares.points_in_regions(points, "id", region, "k", 10.0).filter("within = 1").count() == 499


def test_points_on_surfaces_are_inside(spark):
    from latticework.operators import boundary

    rng = random.Random(11)
    polygons = [*shapes(rng, 20), [square(0, 0, 100, 100), square(30, 10, 90, 90)], [square(0, 0, 100, 100), square(10, 10, 40, 90), square(45, 10, 95, 90)]]
    for r in table(spark, polygons, key=lambda k: k).select("k", boundary.point_on_surface(F.col("rings")).alias("p")).collect():
        assert mask([np.array(ring, float) for ring in polygons[r.k]], np.array([r.p.x]), np.array([r.p.y]))[0], r.k
    flat = spark.createDataFrame([(1, [[{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 1.0}, {"x": 1.0, "y": 1.0}]]), (2, None), (3, [])], f"k int, rings {RINGS}")
    assert [r[0] for r in flat.select(boundary.point_on_surface(F.col("rings"))).collect()] == [None] * 3


def test_nearest_nodes_of_polygons_against_brute_force(spark):
    from latticework.operators import access

    rng = random.Random(13)
    polygons = [p for p in shapes(rng, 15)] + [[square(0, 0, 90, 90), square(20, 20, 70, 70)]]
    nodes = [(k, rng.uniform(-50, 300), rng.uniform(-50, 300)) for k in range(40)]

    def distance(rings, x, y):
        if mask([np.array(r, float) for r in rings], np.array([x]), np.array([y]))[0]:
            return 0.0
        best = np.inf
        for r in rings:
            a = np.array(r, float)
            d = np.roll(a, -1, axis=0) - a
            t = np.clip(((x - a[:, 0]) * d[:, 0] + (y - a[:, 1]) * d[:, 1]) / (d**2).sum(1), 0, 1)
            best = min(best, np.hypot(x - a[:, 0] - t * d[:, 0], y - a[:, 1] - t * d[:, 1]).min())
        return best

    df = spark.createDataFrame(nodes, "node int, x double, y double")
    got = {r.k: r for r in access.nearest_to_polygons(table(spark, polygons, key=lambda k: k), "k", df, "node", 25.0, 16.0).collect()}
    for k, rings in enumerate(polygons):
        d, node = min((distance(rings, x, y), n) for n, x, y in nodes)
        assert got[k].distance == pytest.approx(d, abs=1e-5) and got[k].node == (node if d <= 25 else None)
    none = access.nearest_to_polygons(table(spark, polygons[:2], key=lambda k: k), "k", df.limit(0), "node", 25.0, 16.0).collect()
    assert sorted((r.k, r.node, r.distance) for r in none) == [(0, None, None), (1, None, None)]
