"""The slab sweep against fine rasters, closed forms and the dense grid of rectangles."""

import random
import time

import numpy as np
import pytest

from latticework.operators import geometry


def held(ring, x, y):
    """Which points are inside a ring, by crossings."""
    out = np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if ay != by:
            out ^= ((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay))
    return out


def raster(n=500):
    g = (np.arange(n) + 0.5) / n * 100
    return np.meshgrid(g, g)


def shapes(rng, n):
    out = []
    for _ in range(n):
        c = np.array([rng.uniform(0, 100), rng.uniform(0, 100)])
        if rng.random() < 0.5:
            a = np.sort([rng.uniform(0, 2 * np.pi) for _ in range(rng.randint(3, 7))])
            out.append([c + rng.uniform(5, 25) * np.stack([np.cos(a), np.sin(a)], axis=1)])
        else:
            out.append([geometry.capsule(*c, *(c + [rng.uniform(-40, 40), rng.uniform(-40, 40)]), 6.0, 4)])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_union_and_open_pieces(seed):
    rng = random.Random(seed)
    polygons = shapes(rng, rng.randint(1, 9))
    x, y = raster()
    mask = np.zeros(x.shape, bool)
    for (ring,) in polygons:
        mask |= held(ring, x, y)
    cell = 100 * 100 / mask.size
    box = (0.0, 0.0, 100.0, 100.0)
    assert geometry.union_area(polygons, box) == pytest.approx(mask.sum() * cell, abs=40)
    covered, areas, _ = geometry.open_pieces(polygons, box)
    assert covered + areas.sum() == pytest.approx(10_000, abs=1e-6)
    label = np.where(mask, -1, np.arange(mask.size).reshape(mask.shape))
    while True:  # components of the raster's open points
        new = label.copy()
        for a, b in ((np.s_[1:, :], np.s_[:-1, :]), (np.s_[:, 1:], np.s_[:, :-1])):
            both = (label[a] >= 0) & (label[b] >= 0)
            new[a] = np.where(both, np.minimum(new[a], new[b]), new[a])
            new[b] = np.where(both, np.minimum(new[a], new[b]), new[b])
        free = new >= 0
        new[free] = new.ravel()[new[free]]
        if np.array_equal(new, label):
            break
        label = new
    sizes = np.unique(label[label >= 0], return_counts=True)[1] * cell
    big = lambda v: sorted(a for a in v if a > 60)
    assert big(areas) == pytest.approx(big(sizes), abs=40)


def test_parts_and_outlines_inside():
    box = (0.0, 0.0, 100.0, 100.0)
    square = lambda a, b, c, d: [np.array([(a, b), (c, b), (c, d), (a, d)], float)]
    whole, area, length = geometry.inside([square(10, 10, 60, 60), square(40, 40, 80, 80)], [square(0, 0, 20, 20), square(70, 70, 120, 90), square(90, 0, 95, 5), square(30, 30, 35, 35)], box)
    assert whole == pytest.approx(2500 + 1600 - 400)
    assert area.tolist() == pytest.approx([100, 100, 0, 25])
    assert length.tolist() == pytest.approx([20, 20, 0, 20])


@pytest.mark.parametrize("seed", range(4))
def test_inside_against_raster(seed):
    rng = random.Random(50 + seed)
    cover, others = shapes(rng, 4), shapes(rng, 5)
    x, y = raster(800)
    mask = np.zeros(x.shape, bool)
    for (ring,) in cover:
        mask |= held(ring, x, y)
    cell = 100 * 100 / mask.size
    whole, area, length = geometry.inside(cover, others, (0.0, 0.0, 100.0, 100.0))
    assert whole == pytest.approx(mask.sum() * cell, abs=40)
    for k, (ring,) in enumerate(others):
        assert area[k] == pytest.approx((mask & held(ring, x, y)).sum() * cell, abs=25)
        t = (np.arange(2000) + 0.5) / 2000
        total = 0.0
        for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            p = a + t[:, None] * (b - a)
            on = (p > 0).all(axis=1) & (p < 100).all(axis=1)
            covered = np.zeros(len(p), bool)
            for (c,) in cover:
                covered |= held(c, p[:, 0], p[:, 1])
            total += (on & covered).mean() * np.hypot(*(b - a))
        assert length[k] == pytest.approx(total, abs=0.5)


def test_capsule():
    ring = geometry.capsule(30, 50, 70, 50, 10, 30)
    assert geometry.union_area([[ring]], (0.0, 0.0, 100.0, 100.0)) == pytest.approx(40 * 20 + 0.5 * 120 * 100 * np.sin(2 * np.pi / 120))


def dense(rectangles, box):
    """Open patches of rectangles by the grid of all their coordinates."""
    xs, ys = (np.unique([*(v for r in rectangles for v in np.clip(r[k::2], box[k], box[k + 2])), box[k], box[k + 2]]) for k in (0, 1))
    free = np.ones((len(ys) - 1, len(xs) - 1), bool)
    for a, b, c, d in rectangles:
        free[(ys[:-1] >= b)[:, None] & (ys[1:] <= d)[:, None] & (xs[:-1] >= a)[None, :] & (xs[1:] <= c)[None, :]] = False
    area, seen, out = np.diff(ys)[:, None] * np.diff(xs)[None, :], np.zeros(free.shape, bool), []
    for start in zip(*np.nonzero(free), strict=True):
        todo, size = [start] if not seen[start] else [], 0.0
        while todo:
            i, j = todo.pop()
            if 0 <= i < free.shape[0] and 0 <= j < free.shape[1] and free[i, j] and not seen[i, j]:
                seen[i, j] = True
                size += area[i, j]
                todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        out += [size] if size >= 25 else []
    return area[~free].sum(), out


def test_open_space_joins_patches_across_squares(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for cell in ((0, 0), (2, 1)):
        rectangles = [(cell[1] * 250 + 0, cell[0] * 250 + 120, cell[1] * 250 + 250, cell[0] * 250 + 123)]
        for _ in range(60):
            x, y = cell[1] * 250 + rng.randint(0, 230), cell[0] * 250 + rng.randint(0, 230)
            rectangles.append((x, y, min(x + rng.randint(5, 60), cell[1] * 250 + 250), min(y + rng.randint(5, 40), cell[0] * 250 + 250)))
        rows += [(*cell, *map(float, r)) for r in rectangles]
        covered, patches = dense(np.array(rectangles, float), (cell[1] * 250, cell[0] * 250, cell[1] * 250 + 250, cell[0] * 250 + 250))
        want[cell] = (round(covered, 4), len(patches), round(sum(patches), 4), round(max(patches), 4))
    df = spark.createDataFrame(rows, "row_id long, col_id long, x0 double, y0 double, x1 double, y1 double")
    for crowd in (1000, 10):
        got = {(r.row_id, r.col_id): (round(r.union_area, 4), r.open_patches, round(r.open_area, 4), round(r.largest_patch, 4)) for r in geometry.open_space(df, 250, crowd=crowd).collect()}
        assert got == want


def test_frontage_context(spark):
    roads = spark.createDataFrame([(0, 0, 100.0, 50.0, 125.0, 150.0, 125.0)], "row_id long, col_id long, length double, px0 double, py0 double, px1 double, py1 double")
    ring = lambda a, b, c, d: [[{"x": float(x), "y": float(y)} for x, y in ((a, b), (c, b), (c, d), (a, d))]]
    buildings = spark.createDataFrame([(0, 0, ring(60, 135, 80, 165)), (0, 0, ring(200, 200, 210, 210)), (5, 5, ring(0, 0, 1, 1))], "row_id long, col_id long, rings array<array<struct<x:double,y:double>>>")
    r = geometry.frontage_context(roads, buildings, 250.0, 20.0, 30).first()
    assert (r.road_length, r.building_count) == (100.0, 1)
    assert r.buffer_area == pytest.approx(100 * 40 + 0.5 * 120 * 400 * np.sin(2 * np.pi / 120))
    assert r.building_area == pytest.approx(200) and r.edge_length == pytest.approx(40)


def test_roads_cut_node_by_node_and_by_pairs(spark):
    from latticework.operators import network

    rng = random.Random(3)
    starts = [(rng.randint(-90, 90), rng.randint(-90, 90)) for _ in range(25)]
    lines = [(k, *map(float, (x, y, x + rng.choice([0, 10, -20, 37, 80, -5]), y + rng.choice([0, 10, -20, 33, -70, 15])))) for k, (x, y) in enumerate(starts * 16)]
    lines += [(900 + k, 0.0, 15.0, 40.0 + 10 * k, 15.0) for k in range(4)] + [(950 + k, -35.0, -35.0, 15.0 + k, 15.0 + k) for k in range(4)] + [(-1, 5.0, 5.0, 5.0, 5.0), (-2, 7.0, 3.0, 7.0, 3.0)]

    def parts(own, snap):
        _, x0, y0, x1, y1 = own
        rx, ry, ts = x1 - x0, y1 - y0, {0.0, 1.0}
        for other in lines:
            qx, qy, sx, sy = other[1] - x0, other[2] - y0, other[3] - other[1], other[4] - other[2]
            cross, beside = rx * sy - ry * sx, qx * ry - qy * rx
            if cross and 0 <= beside / cross <= 1:
                ts.add((qx * sy - qy * sx) / cross)
            elif cross == beside == 0 and other[0] != own[0] and rx * rx + ry * ry > 0:
                ts |= {((qx + k * sx) * rx + (qy + k * sy) * ry) / (rx * rx + ry * ry) for k in (0, 1)}
        nodes = [(round((x0 + t * rx) / snap) * snap, round((y0 + t * ry) / snap) * snap) for t in sorted(ts) if 0 <= t <= 1]
        return [(own[0], *a, *b) for a, b in zip(nodes, nodes[1:], strict=False) if a != b]

    df = spark.createDataFrame(lines, "id long, x0 double, y0 double, x1 double, y1 double")
    for snap, size in ((10.0, 50.0), (3.0, 50.0), (0.5, 50.0)):
        assert sorted(map(tuple, network.planarize(df, snap, size).collect())) == sorted(p for own in lines for p in parts(own, snap))


def test_looks_of_roads_on_one_node_grow_with_the_roads():
    import numpy as np
    import pyarrow as pa

    from latticework.operators import network

    rng, took = np.random.default_rng(5), []
    for n in (2_000, 16_000):
        ends = rng.uniform(-60.0, 60.0, (4, n)) + 35.0
        table = pa.table({"r": np.zeros(n, int), "c": np.zeros(n, int), "id": np.arange(n), **dict(zip(("x0", "y0", "x1", "y1"), ends, strict=True))})
        start = time.process_time()
        found = network.block_cuts(10.0, 8)(table)
        took.append(time.process_time() - start)
        assert found.num_rows == n
    assert took[1] < 30 * took[0]


def test_areas_of_rings_in_squares_like_their_clips():
    from latticework.operators import polygons

    rng = np.random.default_rng(9)
    rings = [rng.integers(-20, 60, (rng.integers(1, 9), 2)).astype(float) for _ in range(300)] + [np.array([(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)], float)]
    x0, y0 = rng.integers(-1, 3, (2, len(rings))) * 20.0
    x, y = np.concatenate(rings).T
    ring = np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    want = [abs(polygons.ring_area(polygons.clip_ring(r, (a, b, a + 20, b + 20)))) for r, a, b in zip(rings, x0, y0, strict=True)]
    assert np.allclose(polygons.boxed_areas(x, y, ring, len(rings), x0, y0, 20.0), want, atol=1e-9)


def test_many_boxes_at_once_like_one_by_one(monkeypatch):
    rng = random.Random(8)
    groups = [(shapes(rng, rng.randint(1, 6)), shapes(rng, rng.randint(0, 5))) for _ in range(30)] + [([[np.array([(0, 0), (100, 0), (100, 100), (0, 100)], float)]], [])]
    boxes = np.array([(0.0, 0.0, 100.0, 100.0)] * len(groups))
    cover, others = (sum((geometry.shapes_of(g[k], k, i) for i, g in enumerate(groups[1:], 1)), geometry.shapes_of(groups[0][k], k, 0)) for k in (0, 1))
    for block in (1 << 19, 200):  # blocks of slabs smaller than a box give the same
        monkeypatch.setattr(geometry, "BLOCK", block)
        whole, area, length = geometry.parts_inside(cover + others, boxes)
        covered, (box, areas), _ = geometry.open_parts(cover, boxes)
        area, length = area[len(cover.box) :], length[len(cover.box) :]
        for i, (c, o) in enumerate(groups):
            one = geometry.inside(c, o, tuple(boxes[i]))
            own = others.box == i
            assert whole[i] == pytest.approx(one[0]) and covered[i] == pytest.approx(one[0])
            assert area[own].tolist() == pytest.approx(one[1].tolist()) and length[own].tolist() == pytest.approx(one[2].tolist())
            assert sorted(areas[box == i].tolist()) == pytest.approx(sorted(geometry.open_pieces(c, tuple(boxes[i]))[1].tolist()))
            assert covered[i] + areas[box == i].sum() == pytest.approx(10_000, abs=1e-6)


def test_a_thousand_boxes_take_no_sweep_each():
    rng = random.Random(2)
    many = [shapes(rng, 4) for _ in range(1000)]
    boxes = np.array([(0.0, 0.0, 100.0, 100.0)] * len(many))
    whole = geometry.shapes_of(many[0])
    parts = [geometry.shapes_of(p, 0, i) for i, p in enumerate(many)]
    rings, sizes = np.cumsum([0, *(len(p.polygon) for p in parts)]), np.cumsum([0, *(len(p.box) for p in parts)])
    whole = geometry.Shapes(
        np.concatenate([p.corners for p in parts]), np.concatenate([p.ring + k for p, k in zip(parts, rings, strict=False)]), np.concatenate([p.polygon + k for p, k in zip(parts, sizes, strict=False)]),
        np.concatenate([p.box for p in parts]), np.concatenate([p.layer for p in parts]),
    )
    start = time.process_time()
    covered, _, _ = geometry.open_parts(whole, boxes)
    together = time.process_time() - start
    start = time.process_time()
    single = [geometry.union_area(p, (0.0, 0.0, 100.0, 100.0)) for p in many[:50]]
    alone = (time.process_time() - start) * 20
    assert covered[:50].tolist() == pytest.approx(single) and together < alone / 2
