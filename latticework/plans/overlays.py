"""Queries that return polygons: dissolved, clipped and cut regions, and the areas that outlines enclose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import access, boundary, lattice, overlay, surroundings

from .context import _ELLS, _SQUARES, _ells, _overlapping
from .inputs import ACCESS, COLS, ROADS, ROWS, SIZE, roads, rounded, supplies

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _corners(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Each corner of the outlines, and how many rings turn there."""
    points = polygons.select(*keys, F.explode(F.flatten("rings")).alias("p"))
    return points.groupBy(*keys, F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count(F.lit(1)).alias("rings"))


#: In SQL all is a raster of squares of 10: a point is a corner where one or three of the four squares around it are covered, and one of
#: two rings where two are that meet in the point only.
_RASTER = f"""{_ELLS}, {_SQUARES}, ells AS (SELECT DISTINCT region, x, y FROM (SELECT region, x, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT), 10)) AS y FROM (SELECT region, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT), 10)) AS x, y0, y1 FROM b))),
squares AS (SELECT region + 100 AS region, x, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT), 10)) AS y FROM (SELECT region, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT), 10)) AS x, y0, y1 FROM sq))"""


def _corner_sql(key: str) -> str:
    own = f"{key}, " if key else ""
    return f"""around AS (SELECT {own}x + dx AS x, y + dy AS y, sum(bit) AS m FROM d, (VALUES (0, 0, 1), (10, 0, 2), (0, 10, 4), (10, 10, 8)) v(dx, dy, bit) GROUP BY ALL)
SELECT {own}CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CASE WHEN m IN (6, 9) THEN 2::BIGINT ELSE 1 END AS rings FROM around WHERE m IN (1, 2, 4, 8, 7, 11, 13, 14, 6, 9)"""


@query(f"""WITH {_RASTER}, d AS (SELECT DISTINCT ord, x, y FROM (SELECT n_regionkey AS ord, x, y FROM ells JOIN nation ON n_nationkey = region UNION ALL SELECT n_regionkey + 10, x, y FROM squares JOIN nation ON n_nationkey = region - 100
  UNION ALL SELECT n_regionkey + 10, x, y FROM ells JOIN nation ON n_nationkey = region WHERE region % 5 = 0)), {_corner_sql("ord")}""")
def dissolved_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the polygons of each key made one, some of which overlap."""
    again = _ells(spark, sf_dir).filter("region % 5 = 0").withColumn("ord", F.col("ord") + 10)
    return _corners(overlay.overlay(_overlapping(spark, sf_dir).unionByName(again), keys=["ord"], size=SIZE), ["ord"])


@query(f"WITH {_RASTER}, d AS (SELECT ells.region, ells.x, ells.y FROM ells JOIN squares ON squares.x = ells.x AND squares.y = ells.y), {_corner_sql('region')}")
def clipped_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the regions clipped to the study area."""
    study = _overlapping(spark, sf_dir).filter("region >= 100")
    return _corners(overlay.overlay(_ells(spark, sf_dir), study.select("rings"), "intersection", ["region"], SIZE), ["region"])


@query(f"WITH {_RASTER}, d AS (SELECT DISTINCT s.x, s.y FROM squares s ANTI JOIN ells ON s.x = ells.x AND s.y = ells.y), {_corner_sql('')}")
def uncovered_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of what the regions leave open in the study area."""
    study = _overlapping(spark, sf_dir).filter("region >= 100")
    return _corners(overlay.overlay(study.select("rings"), _ells(spark, sf_dir).select("rings"), "difference", [], SIZE), [])


@query(f"""WITH RECURSIVE {_ELLS}, {_SQUARES}, r AS (SELECT region, x0, y0, x1, y1 FROM b UNION ALL SELECT region + 100, x0, y0, x1, y1 FROM sq),
xs AS (SELECT x, lead(x) OVER (ORDER BY x) AS x1, row_number() OVER (ORDER BY x) AS i FROM (SELECT DISTINCT unnest([x0, x1]) AS x FROM r UNION SELECT -5000 UNION SELECT 20000)),
ys AS (SELECT y, lead(y) OVER (ORDER BY y) AS y1, row_number() OVER (ORDER BY y) AS j FROM (SELECT DISTINCT unnest([y0, y1]) AS y FROM r UNION SELECT -5000 UNION SELECT 20000)),
g AS (SELECT i * 1000 + j AS id, i, j, x, y, (xs.x1 - x) * (ys.y1 - y) AS area, coalesce((SELECT string_agg(DISTINCT region, ',' ORDER BY region) FROM r WHERE r.x0 <= xs.x AND r.x1 > xs.x AND r.y0 <= ys.y AND r.y1 > ys.y), '') AS held FROM xs, ys WHERE xs.x1 IS NOT NULL AND ys.y1 IS NOT NULL),
e AS (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.held = b.held AND abs(a.i - b.i) + abs(a.j - b.j) = 1),
c(id, root) USING KEY (id) AS (SELECT id, id FROM g UNION SELECT e.b, min(c.root) FROM c JOIN e ON e.a = c.id JOIN recurring.c AS k ON k.id = e.b WHERE c.root < k.root GROUP BY 1),
f AS (SELECT root, sum(area) AS area, min([y, x]) AS low, max(CASE WHEN i = 1 AND j = 1 THEN 1 ELSE 0 END) AS outside FROM g JOIN c ON c.id = g.id GROUP BY 1)
SELECT low[2] AS x, low[1] AS y, round(area, 4) AS area FROM f WHERE outside = 0""")
def outline_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas that the outlines of overlapping regions enclose, by their lower left corner."""
    from latticework.operators import network, squares

    edges = squares.oriented_edges(_overlapping(spark, sf_dir), [], "rings", squares.GRAIN)
    lines = network.planarize(edges.withColumnRenamed("edge", "id"), squares.GRAIN, SIZE)
    low = F.array_min(F.transform(F.col("rings")[0], lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    return rounded(overlay.faces(lines, SIZE).select(low.alias("low"), "area").select("low.x", "low.y", "area"), "area", digits=4)


#: Radii of the buffers, and the study area: all of the lattice but a strip, cut into two polygons that overlap.
RADII = [250.0, 400.0, 800.0]
_STUDY = (0.0, 0.0, 5000.0, 4700.0)


@query(f"""WITH {ROADS}, w AS (SELECT {_STUDY[0]}::DOUBLE AS wx0, {_STUDY[1]}::DOUBLE AS wy0, {_STUDY[2]}::DOUBLE AS wx1, {_STUDY[3]}::DOUBLE AS wy1),
cells AS (SELECT r.range AS row_id, c.range AS col_id, c.range * 250.0::DOUBLE + 125 AS cx, r.range * 250.0::DOUBLE + 125 AS cy, radius FROM range({ROWS}) r, range({COLS}) c, (VALUES (250.0::DOUBLE), (400.0::DOUBLE), (800.0::DOUBLE)) v(radius)),
k AS (SELECT range AS k, cos(2 * pi() * range / 96) AS c0, sin(2 * pi() * range / 96) AS s0, cos(2 * pi() * (range + 1) / 96) AS c1, sin(2 * pi() * (range + 1) / 96) AS s1, cos(2 * pi() * (range + 0.5) / 96) AS nc, sin(2 * pi() * (range + 0.5) / 96) AS ns FROM range(96)),
chords AS (SELECT row_id, col_id, radius, cx, cy, cx + radius * c0 AS x0, cy + radius * s0 AS y0, radius * (c1 - c0) AS dx, radius * (s1 - s0) AS dy FROM cells, k),
ct AS (SELECT *, greatest(0, CASE WHEN abs(dx) < 1e-12 THEN 0 ELSE least((wx0 - x0) / dx, (wx1 - x0) / dx) END, CASE WHEN abs(dy) < 1e-12 THEN 0 ELSE least((wy0 - y0) / dy, (wy1 - y0) / dy) END) AS a,
  least(1, CASE WHEN abs(dx) < 1e-12 THEN CASE WHEN x0 BETWEEN wx0 AND wx1 THEN 1 ELSE -1 END ELSE greatest((wx0 - x0) / dx, (wx1 - x0) / dx) END, CASE WHEN abs(dy) < 1e-12 THEN CASE WHEN y0 BETWEEN wy0 AND wy1 THEN 1 ELSE -1 END ELSE greatest((wy0 - y0) / dy, (wy1 - y0) / dy) END) AS b FROM chords, w),
sides AS (SELECT row_id, col_id, radius, cx, cy, v.x0, v.y0, v.x1 - v.x0 AS dx, v.y1 - v.y0 AS dy FROM cells, (SELECT wx0 AS x0, wy0 AS y0, wx1 AS x1, wy0 AS y1 FROM w UNION ALL SELECT wx1, wy0, wx1, wy1 FROM w UNION ALL SELECT wx1, wy1, wx0, wy1 FROM w UNION ALL SELECT wx0, wy1, wx0, wy0 FROM w) v),
st AS (SELECT s.row_id, s.col_id, s.radius, cx, cy, x0, y0, dx, dy, greatest(0, max(CASE WHEN dx * nc + dy * ns < -1e-12 THEN (radius * cos(pi() / 96) - (x0 - cx) * nc - (y0 - cy) * ns) / (dx * nc + dy * ns) END)) AS a,
  least(1, min(CASE WHEN dx * nc + dy * ns > 1e-12 THEN (radius * cos(pi() / 96) - (x0 - cx) * nc - (y0 - cy) * ns) / (dx * nc + dy * ns) END)) AS b FROM sides s, k GROUP BY ALL),
area AS (SELECT row_id, col_id, radius, sum(((x0 + a * dx - cx) * (y0 + b * dy - cy) - (x0 + b * dx - cx) * (y0 + a * dy - cy)) / 2) AS area FROM (SELECT row_id, col_id, radius, cx, cy, x0, y0, dx, dy, a, b FROM ct WHERE a < b UNION ALL SELECT * FROM st WHERE a < b) GROUP BY 1, 2, 3),
rd AS (SELECT id, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM s),
rt AS (SELECT *, greatest(0, CASE WHEN dx = 0 THEN 0 ELSE least((wx0 - x0) / dx, (wx1 - x0) / dx) END, CASE WHEN dy = 0 THEN 0 ELSE least((wy0 - y0) / dy, (wy1 - y0) / dy) END) AS a,
  least(1, CASE WHEN dx = 0 THEN CASE WHEN x0 BETWEEN wx0 AND wx1 THEN 1 ELSE -1 END ELSE greatest((wx0 - x0) / dx, (wx1 - x0) / dx) END, CASE WHEN dy = 0 THEN CASE WHEN y0 BETWEEN wy0 AND wy1 THEN 1 ELSE -1 END ELSE greatest((wy0 - y0) / dy, (wy1 - y0) / dy) END) AS b FROM rd, w),
rc AS (SELECT id, x0 + a * dx AS x0, y0 + a * dy AS y0, (b - a) * dx AS dx, (b - a) * dy AS dy FROM rt WHERE a < b AND (dx <> 0 OR dy <> 0)),
j AS (SELECT row_id, col_id, radius, id, x0 - cx AS qx, y0 - cy AS qy, dx, dy FROM cells JOIN rc ON least(x0, x0 + dx) <= cx + radius AND greatest(x0, x0 + dx) >= cx - radius AND least(y0, y0 + dy) <= cy + radius AND greatest(y0, y0 + dy) >= cy - radius),
whole AS (SELECT *, sqrt(qx * qx + qy * qy) <= radius * cos(pi() / 96) AND sqrt((qx + dx) * (qx + dx) + (qy + dy) * (qy + dy)) <= radius * cos(pi() / 96) AS held FROM j),
jt AS (SELECT row_id, col_id, radius, id, qx, qy, dx, dy, greatest(0, max(CASE WHEN dx * nc + dy * ns < 0 THEN (radius * cos(pi() / 96) - qx * nc - qy * ns) / (dx * nc + dy * ns) END)) AS a, least(1, min(CASE WHEN dx * nc + dy * ns > 0 THEN (radius * cos(pi() / 96) - qx * nc - qy * ns) / (dx * nc + dy * ns) END)) AS b FROM whole, k WHERE NOT held GROUP BY ALL),
lens AS (SELECT row_id, col_id, radius, id, least(CAST(floor(((degrees(atan2(dy, dx)) % 180) + 180) % 180 / 15) AS BIGINT), 11) AS bin, sqrt(dx * dx + dy * dy) * (b - a) AS length FROM (SELECT row_id, col_id, radius, id, dx, dy, 0 AS a, 1 AS b FROM whole WHERE held UNION ALL SELECT row_id, col_id, radius, id, dx, dy, a, b FROM jt WHERE a < b)),
bins AS (SELECT row_id, col_id, radius, bin, sum(length) AS n, count(*) AS k FROM lens WHERE length > 0 GROUP BY 1, 2, 3, 4), shares AS (SELECT *, n / sum(n) OVER (PARTITION BY row_id, col_id, radius) AS p FROM bins),
road AS (SELECT row_id, col_id, radius, sum(n) AS road_length, CAST(sum(k) AS BIGINT) AS segments, -sum(p * ln(p)) / ln(12) AS entropy, max(p) AS dominant_share, count(*) AS bins_used FROM shares GROUP BY 1, 2, 3),
ends AS (SELECT x, y, count(*) AS degree FROM (SELECT x0 AS x, y0 AS y FROM s UNION ALL SELECT x1, y1 FROM s) GROUP BY 1, 2),
nd AS (SELECT row_id, col_id, radius, x - cx AS px, y - cy AS py, degree FROM cells JOIN ends ON abs(x - cx) <= radius AND abs(y - cy) <= radius JOIN w ON x BETWEEN wx0 AND wx1 AND y BETWEEN wy0 AND wy1),
near AS (SELECT * FROM nd WHERE sqrt(px * px + py * py) <= radius * cos(pi() / 96) UNION ALL (SELECT row_id, col_id, radius, px, py, degree FROM nd, k WHERE sqrt(px * px + py * py) > radius * cos(pi() / 96) GROUP BY ALL HAVING max(px * nc + py * ns - radius * cos(pi() / 96)) <= 0)),
node AS (SELECT row_id, col_id, radius, count(*) AS nodes, CAST(sum(CASE WHEN degree >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS intersections, CAST(sum(CASE WHEN degree = 1 THEN 1 ELSE 0 END) AS BIGINT) AS dead_ends, avg(degree) AS mean_degree FROM near GROUP BY 1, 2, 3)
SELECT c.row_id, c.col_id, c.radius, round(48 * c.radius * c.radius * sin(2 * pi() / 96), 4) AS buffer_area, round(area, 2) AS context_area, round(area / (48 * c.radius * c.radius * sin(2 * pi() / 96)), 6) AS coverage, round(coalesce(road_length, 0), 4) AS road_length, coalesce(segments, 0) AS segments,
  coalesce(nodes, 0) AS nodes, coalesce(intersections, 0) AS intersections, coalesce(dead_ends, 0) AS dead_ends, round(coalesce(nodes, 0) / (area / 1e6), 4) AS nodes_per_km2, round(mean_degree, 6) AS mean_degree, round(entropy, 6) AS entropy, round(dominant_share, 6) AS dominant_share, coalesce(bins_used, 0) AS bins_used
FROM cells c JOIN area a ON a.row_id = c.row_id AND a.col_id = c.col_id AND a.radius = c.radius LEFT JOIN road r ON r.row_id = c.row_id AND r.col_id = c.col_id AND r.radius = c.radius LEFT JOIN node n ON n.row_id = c.row_id AND n.col_id = c.col_id AND n.radius = c.radius""")
def network_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads and street nodes within 250, 400 and 800 of each cell's centre, inside a study area."""
    own = roads(spark, sf_dir).select("id", "x0", "y0", "x1", "y1")
    ends = own.select(F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p"))
    nodes = ends.groupBy(F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count(F.lit(1)).alias("degree"))
    x0, y0, x1, y1 = _STUDY
    ring = lambda a, b: F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((a, y0), (b, y0), (b, y1), (a, y1))]))
    study = spark.range(1).select(F.explode(F.array(ring(x0, 3100.0), ring(2300.0, x1))).alias("rings"))
    cells = lattice.grid_cells(spark, ROWS, COLS).select("row_id", "col_id", (F.col("x0") + SIZE / 2).alias("x"), (F.col("y0") + SIZE / 2).alias("y"))
    out = surroundings.buffer_context(cells, ["row_id", "col_id"], own, nodes, study, RADII, float(SIZE))
    out = out.select("row_id", "col_id", "radius", "buffer_area", "context_area", "coverage", "road_length", "segments", "nodes", "intersections", "dead_ends", "nodes_per_km2", "mean_degree", "entropy", "dominant_share", "bins_used")
    return rounded(rounded(rounded(out, "buffer_area", "road_length", "nodes_per_km2", digits=4), "context_area", digits=2), "coverage", "mean_degree", "entropy", "dominant_share")


@query(f"WITH {_ELLS} SELECT region, x + 100 AS x, y + 500 AS y FROM n")
def surface_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point inside each region."""
    return _ells(spark, sf_dir).select("region", boundary.point_on_surface(F.col("rings")).alias("p")).select("region", "p.x", "p.y")


@query(f"""WITH {_ELLS}, {ACCESS}, d AS (SELECT b.region, u.supply_id, min(sqrt(pow(greatest(b.x0 - u.x, 0, u.x - b.x1), 2) + pow(greatest(b.y0 - u.y, 0, u.y - b.y1), 2))) AS d FROM b, u GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY d, supply_id) AS k FROM d) SELECT region, CASE WHEN d <= 300 THEN supply_id END AS supply_id, round(d, 6) AS distance FROM m WHERE k = 1""")
def polygon_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest supply of each region, within 300; one inside is at no distance."""
    return rounded(access.nearest_to_polygons(_ells(spark, sf_dir), "region", supplies(spark, sf_dir), "supply_id", 300.0, float(SIZE)), "distance")


@query(f"WITH {_ELLS} SELECT region, CAST(floor((y + (240000 * 150.0 + 80000 * 500.0) / 320000) / 250) AS BIGINT) AS row_id, CAST(floor((x + (240000 * 400.0 + 80000 * 100.0) / 320000) / 250) AS BIGINT) AS col_id FROM n")
def centroid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice cell of each region's centroid."""
    return lattice.point_cell(boundary.region_areas(_ells(spark, sf_dir), "region"), "cx", "cy", SIZE, ROWS, COLS).select("region", "row_id", "col_id")
