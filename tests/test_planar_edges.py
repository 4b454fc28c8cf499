"""Edges made block by block are those of the cut segments, and segments on top of each other make them once."""

import random

from latticework.operators import network


def test_edges_of_blocks_are_those_of_parts(spark):
    draw = random.Random(3)
    lines = [(k, *(float(draw.randint(-300, 300)) for _ in range(4))) for k in range(150)] + [(150 + k, 0.0, 0.0, 200.0, 200.0) for k in range(3)] + [(160, 5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(lines, "id long, x0 double, y0 double, x1 double, y1 double")
    want = {tuple(r) for r in network.graph_edges(network.planarize(df, 10.0, 250.0), 10.0).select("a", "b", "length").collect()}
    for across in (4, 16):
        got = [tuple(r) for r in network.planar_edges(df, 10.0, 250.0, across).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_block_gives_an_edge_once(spark):
    import pyarrow as pa

    n = 500
    table = pa.table({"id": list(range(n)), "x0": [0.0] * n, "y0": [10.0 * (k % 5) for k in range(n)], "x1": [70.0] * n, "y1": [10.0 * (k % 5) for k in range(n)], "r": [0] * n, "c": [0] * n})
    found = network.block_edges(10.0, 8)(table)
    assert found["id"].null_count == 5 and len(found) == 5 + n
