"""Distances to a crowded shore: as from all pairs, with few spots looked into."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import access, lattice


def test_shore_distance_like_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    lines = [(float(x), float(y), float(x + rng.randint(-150, 150)), float(y + rng.randint(-150, 150))) for x, y in ((rng.randint(0, 2000), rng.randint(0, 300)) for _ in range(600))]
    shore = spark.createDataFrame([*lines, (40.0, 700.0, 40.0, 700.0)], "x0 double, y0 double, x1 double, y1 double")
    cells = lattice.grid_cells(spark, 12, 8, 250)
    d = lattice.square_segment_distance(F.col("x0"), F.col("y0"), 250.0, *[F.col(f"s_{c}") for c in ("x0", "y0", "x1", "y1")])
    every = cells.crossJoin(shore.select(*[F.col(c).alias(f"s_{c}") for c in shore.columns])).groupBy("row_id", "col_id").agg(F.min(d).alias("d"))
    want = {(r.row_id, r.col_id): r.d for r in every.collect()}
    looked, spots = [], access.nearest_spots

    def counted(*args):
        out = spots(*args)
        looked.append(out.count())
        return out

    monkeypatch.setattr(access, "nearest_spots", counted)
    got = {(r.row_id, r.col_id): r.distance for r in access.shore_distance(cells, shore, 250.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert len(looked) > 1 and sum(looked) < len(want) * 40
