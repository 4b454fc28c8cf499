"""Layers written as geopackage parts and read back by the library's reader; nothing is left of a job that failed."""

import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from latticework.operators.polygons import wkb_polygons
from latticework.sources import layers
from latticework.sources.readers import GeopackageSource, wkb

POINT = "struct<x:double,y:double>"


def pt(x, y):
    return {"x": float(x), "y": float(y)}


def test_wkb_of_all_kinds(spark):
    shapes = {"point": (POINT, pt(1, 2)), "linestring": (f"array<{POINT}>", [pt(0, 0), pt(3, 4)]), "polygon": (f"array<array<{POINT}>>", [[pt(0, 0), pt(9, 0), pt(9, 9)], [pt(5, 1), pt(6, 1), pt(6, 2), pt(5, 1)]])}
    shapes["multipoint"], shapes["multilinestring"], shapes["multipolygon"] = (f"array<{POINT}>", [pt(1, 2), pt(3, 4)]), (f"array<array<{POINT}>>", [[pt(0, 0), pt(1, 1)], [pt(2, 2), pt(3, 3), pt(4, 0)]]), (f"array<array<array<{POINT}>>>", [shapes["polygon"][1], [[pt(20, 20), pt(21, 20), pt(20, 22)]]])
    want = {"point": (1, 2, 1, 2), "linestring": (0, 0, 3, 4), "polygon": (0, 0, 9, 9), "multipoint": (1, 2, 3, 4), "multilinestring": (0, 0, 4, 3), "multipolygon": (0, 0, 21, 22)}
    for kind, (ddl, value) in shapes.items():
        df = spark.createDataFrame([(1, value), (2, None)], f"id long, geom {ddl}")
        got = {r.id: r.geom for r in layers.with_wkb(df, "geom", kind).collect()}
        assert got[2] is None and struct.unpack_from("<BI", got[1]) == (1, layers.KINDS[kind])
        x0, x1, y0, y1 = layers.bounds(bytes(got[1]))
        assert (x0, y0, x1, y1) == want[kind]
    rings = wkb_polygons(bytes(layers.encode(6, [[[(0, 0), (9, 0), (9, 9)]], [[(20, 20), (21, 20), (20, 22)]]])))
    assert rings == [[[(0, 0), (9, 0), (9, 9), (0, 0)]], [[(20, 20), (21, 20), (20, 22), (20, 20)]]]
    with pytest.raises(ValueError, match="kind"):
        layers.with_wkb(df, "geom", "circle")


def squares(spark, n=200):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        x, y, s = rng.uniform(0, 1000), rng.uniform(0, 1000), rng.uniform(1, 9)
        rows.append((k, f"name {k}" if k % 5 else None, k / 3, k % 2 == 0, [[pt(x, y), pt(x + s, y), pt(x + s, y + s), pt(x, y + s)]] if k % 7 else None))
    return spark.createDataFrame(rows, f"id long, name string, size double, even boolean, geom array<array<{POINT}>>").repartition(4)


def test_parts_come_back(spark, tmp_path):
    df, path = squares(spark), str(tmp_path / "layer")
    layers.write_layer(df, path, "sq", srs=32635)
    spark.dataSource.register(GeopackageSource)
    back = spark.read.format("geopackage").option("layer", "sq").load(path)
    want = {r.id: r for r in layers.with_wkb(df, "geom", "polygon").collect()}
    rows = back.collect()
    assert {r.id for r in rows} == set(want) and len({r.fid for r in rows}) == 200
    for r in rows:
        w = want[r.id]
        assert (r.name, r.size, bool(r.even), None if r.geom is None else bytes(r.geom)) == (w.name, w.size, w.even, None if w.geom is None else bytes(w.geom))
    near = spark.read.format("geopackage").option("layer", "sq").option("bbox", "100,100,300,300").load(path)
    inside = {r.id for r in df.collect() if r.geom and r.geom[0][2].x >= 100 and r.geom[0][0].x <= 300 and r.geom[0][2].y >= 100 and r.geom[0][0].y <= 300}
    assert {r.id for r in near.collect()} == inside
    part = sorted((tmp_path / "layer").glob("*.gpkg"))[0]
    with sqlite3.connect(part) as con:
        n = con.execute("SELECT count(*) FROM sq WHERE geom IS NOT NULL").fetchone()[0]
        assert con.execute("SELECT count(*) FROM rtree_sq_geom").fetchone()[0] == n > 0
        assert con.execute("SELECT srs_id, geometry_type_name FROM gpkg_geometry_columns").fetchone() == (32635, "POLYGON")
        blob = con.execute("SELECT geom FROM sq WHERE geom IS NOT NULL").fetchone()[0]
    assert blob[:2] == b"GP" and wkb(blob)[:5] == struct.pack("<BI", 1, 3)


def test_append_overwrite_and_empty(spark, tmp_path):
    df, path = squares(spark, 20), str(tmp_path / "layer")
    spark.dataSource.register(GeopackageSource)
    count = lambda: spark.read.format("geopackage").option("layer", "sq").load(path).count()
    layers.write_layer(df, path, "sq")
    layers.write_layer(df, path, "sq")
    assert count() == 40
    layers.write_layer(df.limit(7), path, "sq", mode="overwrite")
    assert count() == 7
    layers.write_layer(df.limit(0), path, "sq", mode="overwrite")
    assert count() == 0


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = tmp_path / "layer"
    layers.write_layer(squares(spark, 20), str(path), "sq")
    before = sorted(p.name for p in path.iterdir())
    broken = squares(spark, 60).withColumn("name", F.when(F.col("id") == 50, F.raise_error(F.lit("broken"))).otherwise(F.col("name")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            layers.write_layer(broken, str(path), "sq", mode=mode)
        assert sorted(p.name for p in path.iterdir()) == before
    with pytest.raises(Exception, match="no column of WKB"):
        squares(spark, 3).drop("geom").write.format("geopackage_parts").mode("append").save(str(path))
