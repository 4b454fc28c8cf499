"""The inverse projection is arithmetic that Spark compiles, exact to 1e-10 degrees up to the poles."""

import math

from pyspark.sql import functions as F

from latticework.functions.projection import TransverseMercator


def test_inverse_is_compiled(spark):
    zone = TransverseMercator.utm(35)
    lat = (F.col("id") / 100.0 - 89.99).alias("lat")
    points = spark.range(17_999).select(lat, (24 + F.col("id") % 600 / 100.0).alias("lon"))
    x, y = zone.forward(F.col("lon"), F.col("lat"))
    lon, lat = zone.inverse(F.col("x"), F.col("y"))
    back = points.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("lon2"), lat.alias("lat2"))
    assert "lambdafunction" not in back._jdf.queryExecution().executedPlan().toString()
    worst = back.agg(F.max(F.greatest(F.abs(F.col("lon") - F.col("lon2")) * F.cos(F.radians("lat")), F.abs(F.col("lat") - F.col("lat2"))))).first()[0]
    assert worst < 1e-10


def test_latitude_series():
    zone = TransverseMercator.utm(35)
    e = zone._eccentricity
    for k in range(-899, 900):
        phi = math.radians(k / 10)
        conformal = math.atan(math.sinh(math.asinh(math.tan(phi)) - e * math.atanh(e * math.sin(phi))))
        assert abs(conformal + sum(d * math.sin(2 * (j + 1) * conformal) for j, d in enumerate(zone._latitudes)) - phi) < 1e-15
