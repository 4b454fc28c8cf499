"""Points of one place and equal rectangles: the answers of all pairs, from one meeting each."""

import io
import re
from contextlib import redirect_stdout

from latticework.operators import panels


def test_many_points_and_rectangles_of_one_place(spark):
    points = [(k, float(k % 3) * 10, 5.0) for k in range(400)] + [(400, None, 1.0), (401, 900.0, 900.0)]
    regions = [(1000 - k, -5.0, 0.0, 5.0 + 20 * (k % 2), 10.0) for k in range(400)] + [(2000, 19.0, 5.0, 20.0, 6.0)]
    p, r = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(regions, "id long, x0 double, y0 double, x1 double, y1 double")
    out = panels.smallest_region(p.withColumnRenamed("id", "point"), r, "point", 250)

    def smallest(x, y):
        held = [((c - a) * (d - b), i) for i, a, b, c, d in regions if x is not None and a <= x <= c and b <= y <= d]
        return (min(held)[1], min(held)[0]) if held else (None, None)

    assert sorted(map(tuple, out.collect())) == [(k, *smallest(x, y)) for k, x, y in points]
    with redirect_stdout(io.StringIO()) as plan:
        out.explain()
    assert len(re.findall(r"HashAggregate\(keys=\[x0#\d+, y0#\d+, x1#\d+, y1#\d+\]", plan.getvalue())) == 2
