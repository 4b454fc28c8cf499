import json
import sqlite3
import struct

import numpy as np
import pytest

from latticework.operators import modeling, network, profile, statistics, zonal
from latticework.sources import readers, writers


def test_keyed_csv_keeps_the_last_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("grid_id,v\na,1\nb,\na,3\n")
    got = sorted((r.grid_id, r.v) for r in readers.keyed_csv(spark, str(tmp_path / "a.csv"), "grid_id").collect())
    assert got == [("a", "3"), ("b", None)]
    with pytest.raises(ValueError):
        readers.keyed_csv(spark, str(tmp_path / "a.csv"), "cell")


def test_typed_csv_with_separator_and_encoding(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("NAME;AREA\nKarşıyaka;1,5\n".encode("utf-8"))
    (tmp_path / "c.csv").write_bytes("NAME;AREA\nMünchen;2\n".encode("latin-1"))
    assert readers.typed_csv(spark, str(tmp_path / "b.csv"), "NAME string, AREA string", sep=";").first().AREA == "1,5"
    assert readers.typed_csv(spark, str(tmp_path / "c.csv"), "NAME string, AREA string", ["NAME"], ";", "ISO-8859-1").first().NAME == "München"


def test_osm_elements(spark, tmp_path):
    ring = [{"lon": x, "lat": y} for x, y in ((0, 0), (2, 0), (2, 2), (0, 0))]
    payload = {"elements": [
        {"type": "node", "id": 1, "lon": 1.0, "lat": 2.0, "tags": {"aeroway": "gate", "shop": "x"}},
        {"type": "way", "id": 2, "tags": {"leisure": "park"}, "geometry": ring},
        {"type": "way", "id": 3, "tags": {"landuse": "quarry"}, "geometry": ring[:2]},
        {"type": "way", "id": 4, "tags": {}, "geometry": ring[:1]},
    ]}
    (tmp_path / "o.json").write_text(json.dumps(payload))
    got = sorted((r.osm_id, r.kind, r.context_class) for r in readers.osm_elements(spark, str(tmp_path / "o.json")).collect())
    assert got == [(1, "point", "airport"), (2, "polygon", "green_open"), (3, "line", "military_quarry")]


def test_geopackage_layer(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    body = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        con.execute("INSERT INTO gpkg_geometry_columns VALUES ('pts', 'geom')")
        con.execute("CREATE TABLE pts (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT, h REAL)")
        con.executemany("INSERT INTO pts VALUES (?, ?, ?, ?)", [(i, b"GP\0\1" + struct.pack("<i", 0) + body, f"n{i}", i / 2) for i in range(1, 8)])
    spark.dataSource.register(readers.GeopackageSource)
    df = spark.read.format("geopackage").option("rowsPerPartition", "3").load(path)
    assert dict(df.dtypes) == {"fid": "bigint", "geom": "binary", "name": "string", "h": "double"}
    rows = df.collect()
    assert len(rows) == 7 and {bytes(r.geom) for r in rows} == {body} and sum(r.h for r in rows) == 14


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), ("50 %", None)], "name string, n int")
    assert writers.markdown_table(df).splitlines()[2] == "| a\\|b | 1 |"
    assert r"50 \%" in writers.latex_table(df)
    assert json.loads(writers.json_manifest(df, size=250))["parameters"] == {"size": 250}
    writers.write_features(df, str(tmp_path / "f"), "n", "csv")
    assert spark.read.csv(str(tmp_path / "f"), header=True).columns == ["n", "name"]


def test_mode_tie_goes_to_the_first_pixel(spark):
    cells = spark.createDataFrame([(0,), (1,)], "cell long")
    px = spark.createDataFrame([(0, "b", 3), (0, "a", 5), (0, "a", 9), (0, "b", 7)], "cell long, label string, px long")
    got = {r.cell: (r.label, r.confidence, r.mixed_flag) for r in zonal.mode_label(cells, px, ["cell"], "label", "px").collect()}
    assert got == {0: ("b", 0.5, 1), 1: (None, 0.0, 1)}


def test_rank_bins_of_small_counts(spark):
    import pandas as pd

    for n in (4, 7, 10, 31):
        df = spark.createDataFrame([(i, float((i * 7) % n)) for i in range(n)], "id long, v double")
        got = {r.id: r.bin for r in statistics.rank_bins(df, "v", "id", 3).collect()}
        want = pd.qcut(pd.Series([float((i * 7) % n) for i in range(n)]).rank(method="first"), 3, labels=False) + 1
        assert got == dict(enumerate(want))


def test_reach_and_service_area(spark):
    edges = spark.createDataFrame([(1, 2, 10.0, 0), (2, 3, 10.0, 3), (1, 3, 50.0, 3), (3, 4, 10.0, 0)], "a long, b long, length double, bin long")
    reached = network.reach(edges, spark.createDataFrame([(1,)], "source long"), 25.0)
    assert sorted((r.node, r.cost) for r in reached.collect()) == [(1, 0.0), (2, 10.0), (3, 20.0)]
    area = network.service_area(edges, reached, [25.0]).first()
    assert area.service_nodes == 3 and area.service_length == 10 + 10 + (25 + 5) + 5
    assert (area.service_edges, area.intersections, area.dead_ends, area.mean_degree) == (4, 1, 0, 7 / 3) and area.dominant_share == 40 / 55


def test_blocks_are_not_split(spark):
    cells = spark.createDataFrame([(r, c, "x" if (r + c) % 3 else "y") for r in range(20) for c in range(20)], "row_id long, col_id long, label string")
    out = modeling.block_folds(cells, "label", 4).groupBy("block").agg({"fold": "min", "*": "count"}).collect()
    assert len(out) == 16
    assert modeling.block_folds(cells, "label", 4).groupBy("fold").count().agg({"count": "max"}).first()[0] == 100


def test_correlations_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 9)) @ rng.normal(0, 1, (9, 9)) + 1e6
    x[:, 8] = x[:, 0] * -3 + 7
    gone = rng.random(x.shape) < 0.2
    names = [f"v{k}" for k in range(9)]
    rows = [tuple(None if g else float(v) for v, g in zip(r, m, strict=True)) for r, m in zip(x, gone, strict=True)]
    rows += [(float("nan"), *[None] * 7, 1.0)]  # v0 and v8 have a row of both that is no number
    got = {(r.a, r.b): r for r in profile.correlation_pairs(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(6), names, 50).collect()}
    assert got.keys() == {(names[i], names[j]) for i in range(9) for j in range(i + 1, 9)} - {("v0", "v8")}
    for (a, b), r in got.items():
        i, j = names.index(a), names.index(b)
        both = ~gone[:, i] & ~gone[:, j]
        assert r.n == both.sum() and r.r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-8)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, float(i)) for i in range(10)], "a double, b double, c double")
    assert profile.correlation_pairs(df, ["a", "b", "c"], 1).count() == 0


def test_clipped_areas_add_up():
    from latticework.operators import polygons

    rng = np.random.default_rng(0)
    for _ in range(20):
        n = rng.integers(4, 12)
        angle, radius = (np.arange(n) + rng.uniform(0, 0.9, n)) * 2 * np.pi / n, rng.uniform(5, 45, n)
        ring = np.stack([50 + radius * np.cos(angle), 50 + radius * np.sin(angle)], axis=1)
        parts = sum(abs(polygons.ring_area(polygons.clip_ring(ring, (c, r, c + 25, r + 25)))) for c in range(0, 100, 25) for r in range(0, 100, 25))
        assert abs(parts - abs(polygons.ring_area(ring))) < 1e-8
    assert abs(polygons.ring_area(polygons.circle(3, 4, 10))) == pytest.approx(0.5 * 96 * 100 * np.sin(2 * np.pi / 96))
    assert len(polygons.clip_ring(polygons.circle(0, 0, 1), (5, 5, 6, 6))) == 0


def test_wkb_polygons():
    from latticework.operators import polygons

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    body = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<dd", *p) for p in ring)
    assert polygons.wkb_polygons(body) == [[ring]]
    assert polygons.wkb_polygons(struct.pack("<BII", 1, 6, 2) + body + body) == [[ring], [ring]]
    point = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    assert polygons.wkb_polygons(struct.pack("<BII", 1, 7, 2) + point + body) == [[ring]]
