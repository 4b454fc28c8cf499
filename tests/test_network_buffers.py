"""Buffers inside a study area: bearings of cut roads, lines as arrays and as columns, rounding as in SQL."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from latticework.operators.surroundings import buffer_context, inside_interval, inside_intervals, nodes_in_study
from latticework.plans.inputs import rounded

POINT = "array<array<struct<x:double,y:double>>>"


def study(spark, *spans):
    return spark.createDataFrame([([[(a, 0.0), (b, 0.0), (b, 470.0), (a, 470.0)]],) for a, b in spans], f"rings {POINT}")


def test_cut_roads_keep_their_bearing(spark):
    rows = [(k, float(x := 37 * k % 500), float(y := 350 + 61 * k % 100), float(x + 101 + k % 7), float(y + 101 + k % 7)) for k in range(60)]
    roads = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 300.0, 300.0)], "k long, x double, y double")
    nodes = spark.createDataFrame([(1.0, 1.0, 1)], "x double, y double, degree long")
    for spans in (((0.0, 700.0),), ((0.0, 310.0), (230.0, 700.0)), ((0.0, 310.0), (330.0, 700.0))):
        got = buffer_context(points, ["k"], roads, nodes, study(spark, *spans), [2000.0], 250.0).first()
        inside = [(b - a, min(y1, 470.0) - y0, x0, x0 + min(y1, 470.0) - y0) for _, x0, y0, x1, y1 in rows for a, b in [(x0, x1)] if y0 < 470]
        gap = [max(0.0, min(e, 330.0) - max(s, 310.0)) if len(spans) == 2 and spans[1][0] == 330.0 else 0.0 for _, _, s, e in inside]
        assert got["bins_used"] == 1 and got["dominant_share"] == 1.0
        assert got["segments"] == sum(1 for (_, d, _, _), g in zip(inside, gap, strict=True) if d - g > 0)
        assert abs(got["road_length"] - sum(d - g for (_, d, _, _), g in zip(inside, gap, strict=True)) * 2**0.5) < 1e-6


def test_lines_as_arrays_and_columns(spark):
    draw = random.Random(5)
    rows = [(draw.choice((-1, 1)) * draw.uniform(1, 900), draw.uniform(-900, 900), draw.uniform(-300, 300), draw.uniform(-300, 300), draw.choice((30.0, 250.0))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "dx double, dy double, qx double, qy double, radius double").coalesce(1)
    want = np.array([tuple(r.s) for r in df.select(inside_interval(*[F.col(c) for c in df.columns]).alias("s")).collect()])
    a, b = inside_intervals(*np.array(rows).T)
    hit = want[:, 0] < want[:, 1]
    assert 100 < hit.sum() < 1900 and (hit == (a < b)).all()
    assert (want[hit] == np.stack([a, b], axis=1)[hit]).all()


def test_nodes_of_covered_and_cut_squares(spark):
    rows = [(float(x), float(y), 1) for x in range(-10, 721, 10) for y in (-10, 0, 10, 250, 460, 470, 480)]
    nodes = spark.createDataFrame(rows, "x double, y double, degree long")
    got = nodes_in_study(nodes, study(spark, (0.0, 310.0), (230.0, 700.0)), 100.0)
    assert sorted((r.x, r.y) for r in got.collect()) == sorted((x, y) for x, y, _ in rows if 0 <= x <= 700 and 0 <= y <= 470)


def test_rounding_at_ties_is_that_of_sql(spark):
    rows = [(k, k / 3200) for k in range(3200, 6400)]
    got = rounded(spark.createDataFrame(rows, "k long, v double"), "v").collect()
    want = duckdb.sql("SELECT range, round(range / 3200.0::DOUBLE, 6) FROM range(3200, 6400)").fetchall()
    assert sorted((r.k, r.v) for r in got) == sorted(want)
