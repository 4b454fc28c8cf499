"""Queries over the lattice: overlays, zonal statistics, networks and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.projection import TransverseMercator
from latticework.operators import access, features, geometry, lattice, modeling, morphology, network, polygons, zonal

from .inputs import ACCESS, BUILDINGS, CELL, CELL_AREA, COLS, PIECES, PIXELS, ROADS, ROWS, SIZE, buildings, origins, pixels, roads, rounded, supplies, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.rectangle_overlay(buildings(spark, sf_dir), SIZE, ROWS, COLS)


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.segment_overlay(roads(spark, sf_dir), SIZE, ROWS, COLS)


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.point_cell(pixels(spark, sf_dir), "x", "y", SIZE, ROWS, COLS)


@query("""SELECT printf('g250_%05d_%05d', r.range, c.range) AS grid_id, r.range AS row_id, c.range AS col_id, c.range * 250.0::DOUBLE AS x0, r.range * 250.0::DOUBLE AS y0,
  c.range * 250.0::DOUBLE + 250 AS x1, r.range * 250.0::DOUBLE + 250 AS y1, 62500.0::DOUBLE AS cell_area_m2 FROM range(20) r, range(20) c""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.grid_cells(spark, ROWS, COLS, SIZE)


@query(f"""WITH {BUILDINGS}, f AS (SELECT *, CASE WHEN floors > 0 AND floors <= 60 THEN 1 ELSE 0 END AS ok FROM p),
g AS (SELECT row_id, col_id, count(*) AS building_count, sum(area) AS building_area, CAST(sum(CASE WHEN floors IS NULL OR floors <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS missing_floors, CAST(sum(CASE WHEN floors > 60 THEN 1 ELSE 0 END) AS BIGINT) AS outlier_floors,
  CAST(sum(ok) AS BIGINT) AS valid_buildings, CAST(max(floors) AS DOUBLE) AS max_raw, CAST(max(CASE WHEN ok = 1 THEN floors END) AS DOUBLE) AS max_valid, sum(ok * area) AS v, coalesce(sum(CASE WHEN ok = 1 THEN area * floors END), 0) AS s1, coalesce(sum(CASE WHEN ok = 1 THEN area * floors * floors END), 0) AS s2,
  coalesce(sum(CASE WHEN ok = 1 AND floors <= 2 THEN area END), 0) AS b1, coalesce(sum(CASE WHEN ok = 1 AND floors > 2 AND floors <= 5 THEN area END), 0) AS b2, coalesce(sum(CASE WHEN ok = 1 AND floors > 5 AND floors <= 10 THEN area END), 0) AS b3, coalesce(sum(CASE WHEN ok = 1 AND floors > 10 THEN area END), 0) AS b4 FROM f GROUP BY 1, 2)
SELECT row_id, col_id, building_count, round(building_area, 4) AS building_area, round(building_area / 62500, 6) AS coverage, missing_floors, outlier_floors, valid_buildings, max_raw, max_valid, round(CASE WHEN v > 0 THEN s1 / v END, 6) AS floors_mean,
  round(CASE WHEN v > 0 THEN sqrt(greatest(s2 / v - (s1 / v) * (s1 / v), 0)) END, 4) AS floors_std, round(CASE WHEN v > 0 THEN s1 / v * 3.2 END, 6) AS height_mean_m, round(CASE WHEN v > 0 THEN s1 / 62500 END, 6) AS floor_area_ratio, round(CASE WHEN v > 0 THEN s1 * 3.2 END, 4) AS volume_m3,
  round(CASE WHEN v > 0 THEN b1 / v END, 6) AS low_area_share, round(CASE WHEN v > 0 THEN b2 / v END, 6) AS mid_area_share, round(CASE WHEN v > 0 THEN b3 / v END, 6) AS upper_area_share, round(CASE WHEN v > 0 THEN b4 / v END, 6) AS high_area_share FROM g""")
def building_floor_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = morphology.floor_stats(_pieces(spark, sf_dir), CELL, CELL_AREA)
    out = rounded(out, "building_area", "floors_std", "volume_m3", digits=4)
    return rounded(out, "coverage", "floors_mean", "height_mean_m", "floor_area_ratio", "low_area_share", "mid_area_share", "upper_area_share", "high_area_share")


@query(f"""WITH {BUILDINGS}, g AS (SELECT row_id, col_id, sum(area) AS a, coalesce(sum(CASE WHEN type = 'mesken' THEN area END), 0) AS m, coalesce(sum(CASE WHEN type = 'isyeri' THEN area END), 0) AS i, coalesce(sum(CASE WHEN type = 'kamu' THEN area END), 0) AS k FROM p GROUP BY 1, 2)
SELECT row_id, col_id, round(m / a, 6) AS share_mesken, round(i / a, 6) AS share_isyeri, round(k / a, 6) AS share_kamu, CASE WHEN greatest(m, i, k) <= 0 THEN '' WHEN m >= i AND m >= k THEN 'mesken' WHEN i >= k THEN 'isyeri' ELSE 'kamu' END AS dominant FROM g""")
def building_type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(morphology.type_shares(_pieces(spark, sf_dir), CELL, ["mesken", "isyeri", "kamu"]), "share_mesken", "share_isyeri", "share_kamu")


@query(f"""WITH {BUILDINGS}, c AS (SELECT *, 2 * (w + h) AS pm, 4 * pi() * area / (4 * (w + h) * (w + h)) AS comp, row_number() OVER (PARTITION BY row_id, col_id ORDER BY area) AS k FROM p),
g AS (SELECT row_id, col_id, count(*) AS n, sum(area) AS a, sum(pm) AS pm, avg(area) AS mean_area, quantile_cont(area, 0.5) AS med, stddev_pop(area) AS sd, sum(k * area) AS ka, sum(comp * area) / sum(area) AS cm, sum(comp * comp * area) / sum(area) AS cs FROM c GROUP BY 1, 2)
SELECT row_id, col_id, n AS building_count, round(a, 4) AS building_area, round(pm, 4) AS perimeter, round(mean_area, 4) AS mean_area, round(med, 4) AS median_area, round(CASE WHEN n > 1 THEN sd / mean_area END, 6) AS area_cv,
  round(2 * ka / (n * a) - (n + 1) / n, 6) AS area_gini, round(cm, 6) AS comp_mean, round(sqrt(greatest(cs - cm * cm, 0)), 4) AS comp_std, round(pm / 6.25, 4) AS perimeter_per_ha FROM g""")
def footprint_morphometrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = morphology.footprint_stats(_pieces(spark, sf_dir), CELL, CELL_AREA)
    return rounded(rounded(out, "building_area", "perimeter", "mean_area", "median_area", "comp_std", "perimeter_per_ha", digits=4), "area_cv", "area_gini", "comp_mean")


@query(f"""WITH {PIXELS} SELECT row_id, col_id, count(value) AS valid_px, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range FROM e WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2""")
def zonal_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(zonal.continuous(_zones(spark, sf_dir), CELL), "mean", "std", digits=9), "min", "max", "range")


@query(f"""WITH {PIXELS}, v AS (SELECT *, value FROM e WHERE value >= 0 AND value < 255)
SELECT row_id, col_id, count(*) AS valid_px, round(avg(value), 9) AS mean_m, round(stddev_pop(value), 9) AS std_m, round(quantile_cont(value, 0.95), 9) AS p95_m, round(max(value), 6) AS max_m,
  round(avg(CASE WHEN value >= 2 THEN 1.0 ELSE 0 END), 6) AS cover_gt2m_share, round(avg(CASE WHEN value >= 5 THEN 1.0 ELSE 0 END), 6) AS cover_gt5m_share, round(avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0 END), 6) AS cover_gt10m_share,
  CAST(sum(CASE WHEN value >= 2 THEN 1 ELSE 0 END) AS DOUBLE) AS area_m2, round(sum(CASE WHEN value >= 2 THEN value ELSE 0 END), 4) AS volume_m3, round(sum(CASE WHEN value >= 2 THEN value ELSE 0 END) / 6.25, 4) AS volume_m3_per_ha FROM v GROUP BY 1, 2""")
def zonal_percentile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = zonal.height_cover(_zones(spark, sf_dir), CELL)
    return rounded(rounded(rounded(out, "mean_m", "std_m", "p95_m", digits=9), "max_m", "cover_gt2m_share", "cover_gt5m_share", "cover_gt10m_share"), "volume_m3", "volume_m3_per_ha", digits=4)


@query(f"""WITH {PIXELS}, cells AS (SELECT r.range AS row_id, c.range AS col_id FROM range(20) r, range(20) c), g AS (SELECT row_id, col_id, label, count(*) AS n, min(px) AS f FROM e GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY row_id, col_id ORDER BY n DESC, f) AS rk, sum(n) OVER (PARTITION BY row_id, col_id) AS t FROM g)
SELECT c.row_id, c.col_id, k.label, round(coalesce(CAST(k.n AS DOUBLE) / k.t, 0), 6) AS confidence, CASE WHEN coalesce(CAST(k.n AS DOUBLE) / k.t, 0) < 0.7 THEN 1 ELSE 0 END AS mixed_flag FROM cells c LEFT JOIN k ON k.row_id = c.row_id AND k.col_id = c.col_id AND rk = 1""")
def zonal_mode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zonal.mode_label(lattice.grid_cells(spark, ROWS, COLS), _zones(spark, sf_dir), CELL, "label", "px"), "confidence")


@query(f"""WITH {PIXELS}, g AS (SELECT row_id, col_id, code, count(*) AS n FROM e GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY row_id, col_id ORDER BY CASE WHEN code IN (10, 20, 50, 60) THEN 0 ELSE 1 END, n DESC, code) AS rk FROM g)
SELECT row_id, col_id, CAST(max(CASE WHEN rk = 1 AND code IN (10, 20, 50, 60) THEN code ELSE 0 END) AS BIGINT) AS majority, round(CAST(sum(CASE WHEN code = 10 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS share_10, round(CAST(sum(CASE WHEN code = 20 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS share_20,
  round(CAST(sum(CASE WHEN code = 50 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS share_50, round(CAST(sum(CASE WHEN code = 60 THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS share_60 FROM k GROUP BY 1, 2""")
def zonal_majority_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zonal.majority_share(_zones(spark, sf_dir), CELL, "code", [10, 20, 50, 60]), "share_10", "share_20", "share_50", "share_60")


@query(f"""WITH {PIXELS}, z AS (SELECT row_id, col_id, avg(value) AS value FROM e GROUP BY 1, 2)
SELECT a.row_id, a.col_id, round(a.value, 9) AS value, count(*) AS n, round(avg(b.value), 9) AS local_mean, round(stddev_pop(b.value), 9) AS local_std FROM z a JOIN z b ON abs(a.row_id - b.row_id) <= 2 AND abs(a.col_id - b.col_id) <= 2 GROUP BY 1, 2, 3""")
def local_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _zones(spark, sf_dir).groupBy(*CELL).agg(F.avg("value").alias("value"))
    return rounded(zonal.local_window(cells, CELL, "value", 2), "value", "local_mean", "local_std", digits=9)


@query(f"""WITH {PIECES}, n AS (SELECT row_id, col_id, least(CAST(floor(((degrees(atan2(dy, dx)) % 180) + 180) % 180 / 15) AS BIGINT), 11) AS bin, sum(length) AS n, count(*) AS k FROM p GROUP BY 1, 2, 3), w AS (SELECT *, n / sum(n) OVER (PARTITION BY row_id, col_id) AS pr FROM n)
SELECT row_id, col_id, round(sum(n), 4) AS road_length, CAST(sum(k) AS BIGINT) AS pieces, round(-sum(pr * ln(pr)) / ln(12.0), 6) AS entropy, round(max(pr), 6) AS dominant_share, count(*) AS bins_used FROM w GROUP BY 1, 2""")
def road_length_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(network.orientation(_lengths(spark, sf_dir), CELL), "road_length", digits=4), "entropy", "dominant_share")


@query(f"""WITH {PIECES}, g AS (SELECT row_id, col_id, sum(CASE WHEN trim(kind) <> '' THEN length ELSE 0 END) AS k, sum(CASE WHEN upper(trim(kind)) = '1-URGENT' THEN length ELSE 0 END) AS m, sum(CASE WHEN upper(trim(coalesce(kind, ''))) <> '1-URGENT' THEN length ELSE 0 END) AS o FROM p GROUP BY 1, 2)
SELECT row_id, col_id, round(k, 4) AS known_length, round(m, 4) AS motorway_length, round(o, 4) AS other_length, round(m / 0.0625, 3) AS motorway_density, round(o / 0.0625, 3) AS other_density, round(m / (m + o), 6) AS motorway_share FROM g""")
def road_class_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = network.class_lengths(_lengths(spark, sf_dir), CELL, "kind", " 1-urgent ", CELL_AREA)
    return rounded(rounded(rounded(out, "known_length", "motorway_length", "other_length", digits=4), "motorway_density", "other_density", digits=3), "motorway_share")


_ENDS = f"""WITH {ROADS}, n AS (SELECT id AS seq, 0 AS k, x0 AS x, y0 AS y FROM s UNION ALL SELECT id, 1, x1, y1 FROM s), z AS (SELECT * FROM n, (VALUES (5.0::DOUBLE), (20.0::DOUBLE)) v(snap_size)),
d AS (SELECT snap_size, CAST(round_even(x / snap_size, 0) AS BIGINT) AS kx, CAST(round_even(y / snap_size, 0) AS BIGINT) AS ky, count(*) AS degree, arg_min(x, seq * 2 + k) AS x, arg_min(y, seq * 2 + k) AS y FROM z GROUP BY 1, 2, 3)"""


@query(f"{_ENDS} SELECT * FROM d WHERE snap_size = 20")
def endpoint_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.endpoints(roads(spark, sf_dir), [20.0], "id")


@query(f"{_ENDS} SELECT snap_size, count(*) AS nodes, CAST(sum(CASE WHEN degree >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS intersections, CAST(sum(CASE WHEN degree = 1 THEN 1 ELSE 0 END) AS BIGINT) AS dead_ends, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree FROM d GROUP BY 1")
def snap_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.snap_summary(network.endpoints(roads(spark, sf_dir), [5.0, 20.0], "id")), "mean_degree")


@query(f"""{_ENDS}, c AS (SELECT CAST(floor(y / 250) AS BIGINT) AS row_id, CAST(floor(x / 250) AS BIGINT) AS col_id, degree FROM d WHERE snap_size = 20 AND x >= 0 AND x < 5000 AND y >= 0 AND y < 5000)
SELECT row_id, col_id, count(*) AS nodes, CAST(sum(CASE WHEN degree >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS intersections, CAST(sum(CASE WHEN degree = 1 THEN 1 ELSE 0 END) AS BIGINT) AS dead_ends, round(avg(degree), 6) AS mean_degree,
  round(count(*) / 0.0625, 4) AS node_density, round(sum(CASE WHEN degree >= 3 THEN 1 ELSE 0 END) / 0.0625, 4) AS intersection_density, round(sum(CASE WHEN degree = 1 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS dead_end_share FROM c GROUP BY 1, 2""")
def node_metrics_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = lattice.point_cell(network.endpoints(roads(spark, sf_dir), [20.0], "id"), "x", "y", SIZE, ROWS, COLS)
    return rounded(rounded(network.node_metrics(nodes, CELL, CELL_AREA), "node_density", "intersection_density", digits=4), "mean_degree", "dead_end_share")


@query(f"""WITH {ACCESS}, z AS (SELECT zone, sum(population) AS total, count(*) AS n, sum(origin_id % 3) AS w FROM a GROUP BY 1)
SELECT origin_id, a.zone, round(CASE WHEN w > 0 THEN total * (origin_id % 3) / w ELSE total / n END, 4) AS allocated FROM a JOIN z ON a.zone = z.zone""")
def dasymetric_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = origins(spark, sf_dir)
    zones = o.groupBy("zone").agg(F.sum("population").alias("total"))
    cells = o.select("origin_id", "zone", (F.col("origin_id") % 3).cast("double").alias("weight")).join(zones, "zone")
    return rounded(access.allocate(cells, "zone", "total", "weight").select("origin_id", "zone", "allocated"), "allocated", digits=4)


_TWO = f"""WITH {ACCESS}, d AS (SELECT origin_id, supply_id, population, capacity, sqrt((a.x - u.x) * (a.x - u.x) + (a.y - u.y) * (a.y - u.y)) AS distance FROM a, u), k AS (SELECT * FROM d, (VALUES (400.0::DOUBLE), (800.0::DOUBLE), (1200.0::DOUBLE)) v(cost) WHERE distance <= cost),
r AS (SELECT cost, supply_id, max(capacity) / sum(population) AS ratio FROM k GROUP BY 1, 2 HAVING sum(population) > 0), g AS (SELECT origin_id, k.cost, sum(ratio) AS access, count(*) AS supplies, sum(capacity) AS supply_area FROM k JOIN r ON r.cost = k.cost AND r.supply_id = k.supply_id GROUP BY 1, 2),
f AS (SELECT a.origin_id, v.cost, a.population, coalesce(access, 0) AS access, coalesce(supplies, 0) AS supplies, coalesce(supply_area, 0) AS supply_area FROM a CROSS JOIN (VALUES (400.0::DOUBLE), (800.0::DOUBLE), (1200.0::DOUBLE)) v(cost) LEFT JOIN g ON g.origin_id = a.origin_id AND g.cost = v.cost)"""


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.point_catchment(origins(spark, sf_dir), supplies(spark, sf_dir), [400.0, 800.0, 1200.0])


@query(f"{_TWO} SELECT origin_id, cost, round(population, 4) AS population, round(access, 6) AS access, supplies, round(supply_area, 3) AS supply_area, round(ln(1 + access), 6) AS access_log1p FROM f")
def two_step_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(rounded(_access(spark, sf_dir), "access", "access_log1p"), "population", digits=4), "supply_area", digits=3)


@query(f"{_TWO} SELECT cost, count(*) AS origins, CAST(sum(CASE WHEN access > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive, round(quantile_cont(access, 0.5), 6) AS median, round(quantile_cont(access, 0.95), 6) AS p95, round(max(access), 6) AS max, round(sum(CASE WHEN access > 0 THEN population ELSE 0 END) / sum(population), 6) AS population_share FROM f GROUP BY 1")
def access_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(access.threshold_summary(_access(spark, sf_dir)), "median", "p95", "max", "population_share")


_EDGES = f"""{ROADS}, h AS (SELECT CAST(round_even(x0 / 100, 0) AS BIGINT) * 2147483648 + CAST(round_even(y0 / 100, 0) AS BIGINT) AS p, CAST(round_even(x1 / 100, 0) AS BIGINT) * 2147483648 + CAST(round_even(y1 / 100, 0) AS BIGINT) AS q, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length FROM s),
g AS (SELECT least(p, q) AS a, greatest(p, q) AS b, min(length) AS length FROM h WHERE p <> q AND length > 0 GROUP BY 1, 2)"""


@query(f"WITH {_EDGES} SELECT a, b, round(length, 6) AS length FROM g")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.graph_edges(roads(spark, sf_dir), 100.0).select("a", "b", "length"), "length")


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM g UNION ALL SELECT b FROM g) GROUP BY 1")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.degrees(network.graph_edges(roads(spark, sf_dir), 100.0))


def wide_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints over a lattice as large as the table needs: octagons and rectangles, each cell with a few whatever the scale."""
    k = F.col("p_partkey")
    x, y = (k * 7919 % 1_000_003 % 9000).cast("double"), (k * 104729 % 1_000_033 % 9000).cast("double") + F.floor(k / 2000) * 9000
    w, h = 10.0 + k % 90, 10.0 + k * 13 % 70
    cut_ = F.when(k % 3 == 0, 0.3).otherwise(0.0)

    def p(a: float, b: float, ca: int, cb: int):
        return F.struct((x + w * (a + cut_ * ca)).alias("x"), (y + h * (b + cut_ * cb)).alias("y"))

    ring = F.array(p(0, 0, 1, 0), p(1, 0, -1, 0), p(1, 0, 0, 1), p(1, 1, 0, -1), p(1, 1, -1, 0), p(0, 1, 1, 0), p(0, 1, 0, -1), p(0, 0, 0, 1))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array(ring).alias("rings"))


@query()
def street_frontage_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street surroundings and the buildings in them by cell, from the geometry; tested against rasters and closed forms."""
    k = F.col("o_orderkey")
    x, y = (k * 7919 % 1_000_003 % 9000).cast("double"), (k * 104729 % 1_000_033 % 9000).cast("double") + F.floor(k / 2000) * 9000
    streets = table(spark, sf_dir, "orders").select(k.alias("id"), x.alias("x0"), y.alias("y0"), (x + k * 31 % 301 - 150).alias("x1"), (y + k * 17 % 307 - 150).alias("y1"))
    pieces = lattice.segment_pieces(streets, SIZE)
    context = geometry.frontage_context(pieces, geometry.touched_cells(wide_buildings(spark, sf_dir), SIZE), float(SIZE), quadrant=4)
    out = morphology.frontage(context, CELL_AREA)
    return rounded(out, *[c for c, kind in out.dtypes if kind == "double"], digits=4)


@query()
def open_space_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open patches of cells with footprints that are no rectangles; tested against rasters."""
    return rounded(geometry.open_space(geometry.touched_cells(wide_buildings(spark, sf_dir), SIZE), SIZE), "union_area", "open_area", "largest_patch", "fragmentation", digits=4)


_CONTEXT_KINDS = ["mesken", "isyeri", "kamu"]


@query(f"""WITH {BUILDINGS}, g AS (SELECT row_id, col_id, type, sum(area) AS a FROM p WHERE w > 0 AND h > 0 GROUP BY 1, 2, 3), {PIXELS.replace('e AS', 'e AS', 1)}, n AS (SELECT row_id, col_id, CASE label WHEN 'click' THEN 'mesken' WHEN 'view' THEN 'isyeri' ELSE 'kamu' END AS type, count(*) AS k FROM e WHERE row_id < 20 AND col_id < 20 GROUP BY 1, 2, 3)
SELECT c.row_id, c.col_id, {', '.join(f"round(coalesce(max(CASE WHEN g.type = '{k}' THEN a END), 0), 4) AS area_{k}, round(least(coalesce(max(CASE WHEN g.type = '{k}' THEN a END), 0) / 62500, 1), 6) AS share_{k}, CASE WHEN coalesce(max(CASE WHEN g.type = '{k}' THEN a END), 0) > 0 THEN 1 ELSE 0 END AS flag_{k}, CAST(coalesce(max(CASE WHEN n.type = '{k}' THEN k END), 0) AS BIGINT) AS points_{k}" for k in _CONTEXT_KINDS)} FROM cells c LEFT JOIN g ON g.row_id = c.row_id AND g.col_id = c.col_id LEFT JOIN n ON n.row_id = c.row_id AND n.col_id = c.col_id GROUP BY 1, 2""")
def context_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = _pieces(spark, sf_dir).filter("type IS NOT NULL").select(*CELL, F.col("type").alias("kind"), "area")
    lengths = _lengths(spark, sf_dir).select(*CELL, F.col("kind"), "length")
    kind = F.when(F.col("label") == "click", "mesken").when(F.col("label") == "view", "isyeri").otherwise("kamu")
    points = _zones(spark, sf_dir).select(*CELL, kind.alias("kind"))
    out = zonal.context_measures(lattice.grid_cells(spark, ROWS, COLS), areas, lengths, points, CELL, _CONTEXT_KINDS, CELL_AREA)
    kept = [f"{what}_{k}" for k in _CONTEXT_KINDS for what in ("area", "share", "flag", "points")]
    return rounded(rounded(out.select(*CELL, *kept), *[c for c in kept if c.startswith("area")], digits=4), *[c for c in kept if c.startswith("share")])


@query()
def open_space_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.open_space(_pieces(spark, sf_dir), SIZE), "union_area", "open_area", "largest_patch", "fragmentation", digits=4)


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _zones(spark, sf_dir).groupBy(*CELL).agg(F.avg("value").alias("a"), F.max("value").alias("b"), F.stddev_pop("value").alias("c"), F.max_by("label", F.struct("value", "px")).alias("label"))
    cells = cells.withColumn("grid_id", lattice.cell_name(F.col("row_id"), F.col("col_id"), SIZE))
    return modeling.block_folds(cells, "label", 3)


@query()
def held_out_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modeling.held_out_predictions(_model_rows(spark, sf_dir), ["a", "b", "c"], "label", "fold", trees=10, depth=5)


@query()
def held_out_extra_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modeling.held_out_predictions(_model_rows(spark, sf_dir), ["a", "b", "c"], "label", "fold", "extra_trees", trees=8, depth=4)


@query()
def held_out_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modeling.held_out_predictions(_model_rows(spark, sf_dir), ["a", "b", "c"], "label", "fold", "boosted_leaves", trees=2, depth=3)


@query()
def gain_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain importances of boosted trees by family of columns, over folds."""
    rows = _model_rows(spark, sf_dir).select("grid_id", "label", "fold", F.col("a").alias("building_value"), F.col("b").alias("road_value"), F.col("c").alias("building_spread"))
    gains = modeling.gain_importances(rows, ["building_value", "road_value", "building_spread"], "label", "fold")
    return features.importance_by_family(gains.withColumn("model", F.lit("boosted")), ["model"])


@query(f"WITH {BUILDINGS} SELECT id, row_id, col_id, round(area, 4) AS area FROM p WHERE area > 0")
def polygon_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints as rings through the polygon kernel; for rectangles the closed form is the oracle."""
    corners = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    rings = buildings(spark, sf_dir).select("id", F.array(corners).alias("rings"))
    return rounded(polygons.polygon_overlay(rings, SIZE, ROWS, COLS), "area", digits=4)


@query("""SELECT event_id, round(20 + event_id * 7919 % 20000 / 1000.0, 9)::DOUBLE AS lon, round(event_id * 104729 % 160000 / 1000.0 - 80, 9)::DOUBLE AS lat FROM events""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees through a transverse Mercator projection and back."""
    k = F.col("event_id")
    zone = TransverseMercator.utm(35)
    x, y = zone.forward(F.col("lon"), F.col("lat"))
    own = table(spark, sf_dir, "events").select("event_id", (20 + k * 7919 % 20000 / 1000.0).alias("lon"), (k * 104729 % 160000 / 1000.0 - 80).alias("lat")).select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = zone.inverse(F.col("x"), F.col("y"))
    return rounded(own.select("event_id", lon.alias("lon"), lat.alias("lat")), "lon", "lat", digits=9)
