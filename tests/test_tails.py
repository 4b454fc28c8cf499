"""Tail probabilities against closed forms, tables and all orders of small samples; the projection against published control points."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from latticework.functions import tails
from latticework.functions.projection import TransverseMercator


def t_tail(t, v):
    """Student's two-sided tail for whole degrees of freedom, by its finite sum."""
    angle = math.atan(abs(t) / math.sqrt(v))
    c, s = math.cos(angle), math.sin(angle)
    if v % 2:
        total, term = 0.0, c
        for k in range(1, v - 1, 2):
            total += term
            term *= c * c * (k + 1) / (k + 2)
        return 1 - 2 / math.pi * (angle + s * total)
    total, term = 1.0, 1.0
    for k in range(1, v - 2, 2):
        term *= c * c * k / (k + 1)
        total += term
    return 1 - s * total


def test_student(spark):
    rows = [(float(t), v) for t in (0.0, 1e-3, 0.5, 1.0, 2.2281388519649385, 4.302652729911275, 12.706204736432095, 40.0) for v in (1, 2, 3, 5, 10, 30, 201, 4000)]
    for r in spark.createDataFrame(rows, "t double, v int").withColumn("p", tails.student_tail(F.col("t"), F.col("v"))).collect():
        assert r.p == pytest.approx(t_tail(r.t, r.v), abs=1e-9), r
    # Published quantiles of 0.05.
    got = spark.createDataFrame([(12.706204736432095, 1), (4.302652729911275, 2), (2.2281388519649385, 10), (2.0422724563012373, 30)], "t double, v int").select(tails.student_tail(-F.col("t"), F.col("v"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.05] * 4, abs=1e-9)


def test_student_of_many_degrees_meets_both_ways(spark):
    df = spark.createDataFrame([(t,) for t in (0.1, 1.0, 2.5, 5.0)], "t double")
    near = df.select(tails.student_tail(F.col("t"), F.lit(tails.MANY)).alias("a"), tails.student_tail(F.col("t"), F.lit(tails.MANY + 1)).alias("b"), tails.student_tail(F.col("t"), F.lit(10**10)).alias("c"), "t").collect()
    for r in near:
        assert r.a == pytest.approx(r.b, abs=1e-7) and r.c == pytest.approx(math.erfc(r.t / math.sqrt(2)), abs=1e-9)
    assert df.select(tails.student_tail(F.col("t"), F.lit(0))).first()[0] is None


def test_normal_and_chi_square(spark):
    rows = [(x,) for x in (0.0, 0.01, 0.5, 1.0, 2.0, 3.841458820694124, 9.0, 25.0, 80.0)]
    for r in spark.createDataFrame(rows, "x double").select("x", tails.normal_tail(F.col("x")).alias("z"), *[tails.chi_square_tail(F.col("x"), F.lit(k)).alias(f"c{k}") for k in (1, 2, 4, 9)]).collect():
        assert r.z == pytest.approx(math.erfc(r.x / math.sqrt(2)), abs=1e-10)
        assert r.c1 == pytest.approx(math.erfc(math.sqrt(r.x / 2)), abs=1e-10)
        assert r.c2 == pytest.approx(math.exp(-r.x / 2), abs=1e-10)
        assert r.c4 == pytest.approx(math.exp(-r.x / 2) * (1 + r.x / 2), abs=1e-10)
        odd = math.erfc(math.sqrt(r.x / 2)) + math.sqrt(2 / math.pi) * math.exp(-r.x / 2) * sum(r.x ** (k - 0.5) / math.prod(range(1, 2 * k, 2)) for k in range(1, 5))
        assert r.c9 == pytest.approx(odd, abs=1e-9)


@pytest.mark.parametrize(("m", "n"), [(1, 1), (3, 4), (5, 5), (2, 7)])
def test_two_samples_against_all_orders(spark, m, n):
    seen = []
    for first in itertools.combinations(range(m + n), m):
        a = b = 0
        far = 0
        for k in range(m + n):
            a, b = a + (k in first), b + (k not in first)
            far = max(far, abs(a * n - b * m))
        seen.append(far)
    for d in sorted(set(seen)):
        assert tails.paths_outside(d / (m * n), m, n) == pytest.approx(sum(x >= d for x in seen) / len(seen), abs=1e-12)
    got = spark.createDataFrame([(d / (m * n), m, n) for d in sorted(set(seen))], "d double, m long, n long").select(tails.two_sample_tail(F.col("d"), F.col("m"), F.col("n"))).collect()
    assert got[-1][0] == pytest.approx(sum(x >= max(seen) for x in seen) / len(seen))


def test_large_samples_meet_the_exact_count(spark):
    r = spark.createDataFrame([(0.02, 9_000, 12_000)], "d double, m long, n long").select(tails.two_sample_tail(F.col("d"), F.col("m"), F.col("n"))).first()
    assert r[0] == pytest.approx(tails.paths_outside(0.02, 9_000, 12_000), rel=0.02)


def test_published_control_points(spark):
    """A water tower of the British grid (Airy 1830), and the quarter meridian of WGS 84."""
    airy = TransverseMercator(-2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0, 6_377_563.396, 1 - 6_356_256.909 / 6_377_563.396)
    lon, lat = 1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600
    x, y = airy.forward(F.lit(lon), F.lit(lat))
    r = spark.range(1).select(x, y, *TransverseMercator.utm(35).forward(F.lit(27.0), F.lit(90.0 - 1e-9))).first()
    assert (r[0], r[1]) == pytest.approx((651_409.903, 313_177.270), abs=2e-3)
    assert (r[2], r[3]) == pytest.approx((500_000.0, 0.9996 * 10_001_965.7293), abs=1e-3)


def test_round_trip(spark):
    rows = [(27 + a, b) for a in (-20.0, -3.0, -0.1, 0.0, 1.7, 3.0, 20.0) for b in (-80.0, -41.3, -1e-6, 0.0, 12.0, 41.0082, 84.0)]
    for tm in (TransverseMercator.utm(35), TransverseMercator.utm(35, south=True), TransverseMercator(27.0, 38.0, 1.0, 0.0, 0.0)):
        df = spark.createDataFrame(rows, "lon double, lat double")
        x, y = tm.forward(F.col("lon"), F.col("lat"))
        lon, lat = tm.inverse(F.col("x"), F.col("y"))
        for r in df.withColumn("x", x).withColumn("y", y).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
            assert abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9, r  # a tenth of a millimetre
