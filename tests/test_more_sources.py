"""Rasters, windows, spatial filters, encodings, relations and the small writers."""

import json
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import evaluation, lattice, matching, merge, modeling, network, zonal
from latticework.sources import raster, readers, writers


def grid(path, values, nodata=-9999.0, order="LSBFIRST"):
    rows, cols = values.shape
    values.astype("<f4" if order == "LSBFIRST" else ">f4").tofile(path)
    path.with_suffix(".hdr").write_text(f"NCOLS {cols}\nNROWS {rows}\nXLLCORNER 100\nYLLCORNER 200\nCELLSIZE 10\nNODATA_VALUE {nodata}\nBYTEORDER {order}\n")


@pytest.mark.parametrize("order", ["LSBFIRST", "MSBFIRST"])
def test_raster_rows_and_windows(spark, tmp_path, order):
    values = np.arange(12, dtype=float).reshape(3, 4)
    values[1, 2], values[0, 0] = -9999, np.nan
    grid(tmp_path / "a.flt", values, order=order)
    grid(tmp_path / "b.flt", values * 10, order=order)
    got = raster.raster_bands(spark, {"a": str(tmp_path / "a.flt"), "b": str(tmp_path / "b.flt")})
    rows = {(r.row, r.col): r for r in got.collect()}
    assert len(rows) == 12 and rows[0, 0].a is None and rows[1, 2].a is None and rows[2, 3].a == 11 and rows[2, 3].b == 110
    assert (rows[0, 0].x, rows[0, 0].y, rows[2, 3].x, rows[2, 3].y, rows[2, 3].px) == (105, 225, 135, 205, 11)
    for box in ((110, 200, 130, 220), (105, 205, 125, 225), (104, 206, 126, 226), (0, 0, 50, 50)):
        part = raster.raster_bands(spark, {"a": str(tmp_path / "a.flt")}, box).collect()
        want = {k for k, r in rows.items() if box[0] <= r.x < box[2] and box[1] <= r.y < box[3]}
        assert {(r.row, r.col) for r in part} == want, box
    # A band goes on to the zonal statistics of the lattice.
    zones = lattice.point_cell(got.withColumnRenamed("a", "value"), "x", "y", 20, 20, 20)
    assert zonal.continuous(zones, ["row_id", "col_id"]).agg(F.sum("valid_px")).first()[0] == 10
    raster.write_grid(got.select("row", "col", F.col("a").alias("value")), str(tmp_path / "c.flt"), 3, 4, 100, 200, 10)
    again = {(r.row, r.col): r.c for r in raster.raster_bands(spark, {"c": str(tmp_path / "c.flt")}).collect()}
    assert again == {k: r.a for k, r in rows.items()}


@pytest.mark.parametrize("index", [False, True])
def test_geopackage_bbox(spark, tmp_path, index):
    path = str(tmp_path / "x.gpkg")

    def blob(x):
        return b"GP\0\3" + struct.pack("<i4d", 0, x, x + 1, 0, 1) + struct.pack("<BIdd", 1, 1, x, 0)

    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        con.execute("INSERT INTO gpkg_geometry_columns VALUES ('pts', 'geom')")
        con.execute("CREATE TABLE pts (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
        con.executemany("INSERT INTO pts VALUES (?, ?, ?)", [(i, blob(10 * i), f"n{i}") for i in range(1, 8)])
        if index:
            con.execute("CREATE VIRTUAL TABLE rtree_pts_geom USING rtree(id, minx, maxx, miny, maxy)")
            con.executemany("INSERT INTO rtree_pts_geom VALUES (?, ?, ?, 0, 1)", [(i, 10 * i, 10 * i + 1) for i in range(1, 8)])
    spark.dataSource.register(readers.GeopackageSource)
    read = spark.read.format("geopackage").option("rowsPerPartition", "2")
    assert {r.name for r in read.option("bbox", "21,0,40,9").load(path).collect()} == {"n2", "n3", "n4"}
    assert read.option("bbox", "21,5,40,9").load(path).count() == 0


def test_decoded_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿NAME;AREA\nKarşıyaka;1,5\n\"a;b\";\n".encode())
    (tmp_path / "b.csv").write_bytes("NAME;AREA\nÇiğli ş;2\n".encode("cp1254"))
    got = sorted((r.source_file.rsplit("/")[-1], r.source_row, r.NAME, r.AREA) for r in readers.decoded_csv(spark, str(tmp_path / "*.csv"), ["NAME", "AREA"]).collect())
    assert got == [("a.csv", 2, "Karşıyaka", "1,5"), ("a.csv", 3, "a;b", None), ("b.csv", 2, "Çiğli ş", "2")]


def test_relations_close_their_outer_ways(spark, tmp_path):
    point = lambda x, y: {"lon": float(x), "lat": float(y)}
    way = lambda role, *ps: {"type": "way", "role": role, "geometry": [point(*p) for p in ps]}
    payload = {"elements": [
        {"type": "relation", "id": 1, "tags": {"leisure": "park"}, "members": [way("outer", (0, 0), (2, 0), (2, 2)), way("", (0, 0), (0, 2), (2, 2)), way("inner", (1, 1), (1, 1.5), (1.2, 1), (1, 1)), way("outer", (5, 5), (6, 5), (6, 6), (5, 5))]},
        {"type": "relation", "id": 2, "tags": {}, "members": [way("outer", (0, 0), (1, 1))]},
        {"type": "node", "id": 3, "lon": 1.0, "lat": 1.0},
    ]}
    (tmp_path / "o.json").write_text(json.dumps(payload))
    rows = readers.osm_relations(spark, str(tmp_path / "o.json")).collect()
    assert [(r.osm_id, r.context_class, sorted(len(x) for x in r.rings)) for r in rows] == [(1, "green_open", [4, 5])]
    assert readers.json_manifest(spark, str(tmp_path / "o.json")) == payload


def test_small_writers(spark, tmp_path):
    df = spark.createDataFrame([("Çiğli", 1), ("a,b", None)], "name string, n int")
    assert writers.marked_csv(df) == "﻿name,n\nÇiğli,1\n\"a,b\",\n".encode()
    assert writers.bibtex_ascii("Öztürk".replace("Ö", "ö") + " – ş") == r'{\"o}zt{\"u}rk -- {\c{s}}'
    with pytest.raises(ValueError):
        writers.bibtex_ascii("中")
    writers.write_layers({"a": df, "b": df.limit(0)}, str(tmp_path / "layers"))
    assert spark.read.parquet(str(tmp_path / "layers/a")).count() == 2 and spark.read.parquet(str(tmp_path / "layers/b")).columns == ["name", "n"]
    kinds = spark.createDataFrame([("polygon", 1), ("line", 2)], "kind string, n int")
    writers.split_by_kind(kinds, str(tmp_path / "kinds"))
    assert [spark.read.parquet(str(tmp_path / f"kinds/{k}s")).count() for k in ("polygon", "line", "point")] == [1, 1, 0]


def test_merge_checks_and_flags(spark):
    df = spark.createDataFrame([("a", "1", "0.5"), ("b", "1.0", "x"), ("c", None, "-1")], "k string, f string, n string")
    assert merge.require_one_to_one(df, "k").count() == 3
    with pytest.raises(ValueError):
        merge.require_one_to_one(df.unionByName(df), "k")
    got = merge.presence_flags(merge.any_flag(df, "any", ["f", "gone"]), {"has": "n"}).orderBy("k").collect()
    assert [(r["any"], r.has) for r in got] == [("1", "1"), ("0", "0"), ("0", "0")]
    right = spark.createDataFrame([("a", "y", ""), ("d", "z", "q")], "k string, f string, g string")
    chained = merge.merge_chain(df, [right], "k")
    chained = chained[0] if isinstance(chained, tuple) else chained
    assert [(r.f, r.g) for r in chained.orderBy("k").collect()] == [("y", ""), ("1.0", None), (None, None)]


def test_window_needs_enough_cells(spark):
    cells = spark.createDataFrame([(r, c, float(r + c)) for r in range(3) for c in range(3)] + [(9, 9, 1.0)], "row_id long, col_id long, v double")
    got = {(r.row_id, r.col_id): (r.n, r.local_mean) for r in zonal.local_window(cells, ["row_id", "col_id"], "v", 2, 9).collect()}
    assert got[1, 1] == (9, 2.0) and got[9, 9] == (1, None)


def test_components_against_search(spark):
    import random

    rng = random.Random(7)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(50)]
    edges = [(a, b) for a, b in edges if a != b]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r.node: r.root for r in network.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_letter_bounds_hold(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(2)
    rows = [("".join(rng.choices("abc 1ü", k=rng.randint(0, 9))), "".join(rng.choices("abc 1ü", k=rng.randint(1, 9)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", matching.letter_counts(F.col("a")).alias("x"), matching.letter_counts(F.col("b")).alias("y"))
    assert all(r.m >= SequenceMatcher(None, r.a, r.b).ratio() - 1e-9 for r in df.withColumn("m", matching.most_similar("x", "y")).collect())


@pytest.mark.parametrize("kind", ["random_forest", "extra_trees", "boosted", "boosted_leaves"])
def test_held_out_models(spark, kind):
    import random

    rng = random.Random(1)
    rows = [(str(i), "d%d" % (i % 3 if i else 7), "abc"[i % 3], float(i % 3) + rng.uniform(-0.3, 0.3), None if i % 10 == 0 else rng.random()) for i in range(180)]
    df = spark.createDataFrame(rows, "grid_id string, district string, label string, u double, v double")
    df = df.withColumn("district", F.when(F.col("grid_id").cast("int") < 90, "p").otherwise(F.when(F.col("grid_id").cast("int") < 175, "q").otherwise("r")))
    out = modeling.held_out_predictions(df, ["u", "v"], "label", "district", kind, trees=5, depth=3, least_rows=50)
    rows = out.collect()
    assert {r.district for r in rows} == {"p", "q"} and len(rows) == 175
    # Extra trees draw one of the two features per node, and one of these is noise.
    assert sum(r.true_label == r.predicted_label for r in rows) > (0.8 if kind == "extra_trees" else 0.9) * len(rows)
    assert all(len(r.probabilities) == 3 and abs(sum(r.probabilities) - 1) < 1e-6 for r in rows)
    assert evaluation.confusion(out.withColumn("m", F.lit(1)), ["a", "b", "c"], ["m"]).count() == 9


def test_spaced_and_separated_points(spark):
    import hashlib
    import random

    from latticework.operators import boundary

    rng = random.Random(4)
    rows = [(k, k % 3, rng.uniform(0, 1000), rng.uniform(0, 1000)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, zone int, x double, y double")
    want = set()
    for zone in range(3):
        order = sorted((r for r in rows if r[1] == zone), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
        apart = []
        for r in order:
            if all((r[2] - o[2]) ** 2 + (r[3] - o[3]) ** 2 >= 250**2 for o in apart):
                apart.append(r)
        picked = apart[:20] + [r for r in order if r not in apart][: max(0, 20 - len(apart))]
        want |= {(zone, r[0]) for r in picked}
    got = boundary.spaced_sample(df, "zone", "id", 20, 250.0).collect()
    assert {(r.zone, r.id) for r in got} == want
    best, taken = sorted(rows, key=lambda r: (-r[2], r[0])), []
    for r in best:
        if len(taken) < 4 and all((r[2] - o[2]) ** 2 + (r[3] - o[3]) ** 2 >= 300**2 for o in taken):
            taken.append(r)
    got = boundary.separated(df, "id", F.col("x"), 4, 300.0).orderBy("position").collect()
    assert [r.id for r in got] == [r[0] for r in taken]
