"""Access where many origins and supplies share a place: pairs are between places, answers are those of all pairs of points."""

import random

import pytest
from pyspark.sql import functions as F

from latticework.operators import access, lattice, network

COSTS = [150.0, 300.0]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(11)
    o = [(k, rng.choice([0.0, 100.0, 210.0]), rng.choice([0.0, 130.0]), float(rng.randint(0, 5))) for k in range(300)] + [(300, 9000.0, 9000.0, 1.0), (301, None, 5.0, 2.0)]
    s = [(k, rng.choice([20.0, 180.0]), rng.choice([10.0, 120.0]), float(rng.randint(1, 9))) for k in range(200)]
    return spark.createDataFrame(o, "origin_id long, x double, y double, population double"), spark.createDataFrame(s, "supply_id long, x double, y double, capacity double")


def rows(df):
    return sorted((r[0], r[1], *[x if x is None or isinstance(x, bool | int) else round(x, 6) for x in r[2:]]) for r in df.collect())


def all_pairs(o, s):
    both = lattice.near_pairs(o, s, max(COSTS), ["origin_id", "population"], ["supply_id", "capacity"])
    return both.withColumnsRenamed({"r_supply_id": "supply_id", "r_capacity": "capacity"})


def test_point_catchment(points):
    o, s = points
    want = access.two_step_catchment(all_pairs(o, s), o, COSTS)
    assert rows(access.point_catchment(o, s, COSTS).select(want.columns)) == rows(want)
    assert access.places(o, "origin_id", ["x", "y"], "population").count() == 8


def test_network_catchment_and_supplies(spark, points):
    o, s = points[0].filter("x IS NOT NULL"), points[1]
    roads = spark.createDataFrame([(k, float(a), float(b), float(c), float(d)) for k, (a, b, c, d) in enumerate([(0, 0, 100, 0), (100, 0, 200, 0), (200, 0, 200, 100), (100, 0, 100, 100), (100, 100, 200, 100)])], "id long, x0 double, y0 double, x1 double, y1 double")
    edges = network.graph_edges(roads, 100.0)
    nodes = network.graph_nodes(edges, 100.0)
    boxes = s.select("supply_id", "capacity", *[(F.col(c) + k).alias(n) for n, c, k in (("x0", "x", -5), ("y0", "y", -5), ("x1", "x", 5), ("y1", "y", 5))])
    own, others = access.snap_to_network(o, "origin_id", nodes, 60.0), access.snap_to_network(boxes, "supply_id", nodes, 60.0)
    pairs = access.network_pairs(edges, own, others, max(COSTS))
    want = access.two_step_catchment(pairs, own.withColumn("available", F.col("node").isNotNull()), COSTS, available="available")
    assert rows(access.network_catchment(edges, nodes, o, boxes, COSTS, 60.0).select(want.columns)) == rows(want)
    ratios = access.supply_ratios(pairs, others, COSTS).select("supply_id", "cost", "capacity", "node", "snap", "demand", "ratio")
    assert rows(access.network_supplies(edges, nodes, o, boxes, COSTS, 60.0).select(ratios.columns)) == rows(ratios)
