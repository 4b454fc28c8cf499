"""Queries of networks, access over them, boundaries and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators import access, boundary, lattice, network, overlay, ranking

from .inputs import ACCESS, ROADS, SIZE, origins, roads, rounded, supplies, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {ACCESS}, d AS (SELECT origin_id, supply_id, sqrt((a.x - u.x) * (a.x - u.x) + (a.y - u.y) * (a.y - u.y)) AS distance FROM a, u), m AS (SELECT *, row_number() OVER (PARTITION BY origin_id ORDER BY distance, supply_id) AS k FROM d)
SELECT a.origin_id, CASE WHEN m.distance <= 600 THEN m.supply_id END AS supply_id, round(m.distance, 6) AS distance FROM a LEFT JOIN m ON m.origin_id = a.origin_id AND k = 1""")
def nearest_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every origin's distance to its nearest supply, and that supply where it is within 600."""
    return rounded(access.nearest(origins(spark, sf_dir), "origin_id", supplies(spark, sf_dir), "supply_id", 600.0), "distance")


SNAP = 100.0
#: Supplies are squares around their point; the graph leaves out one road class.
EXCLUDED = "1-URGENT"
_GRAPH = f"""{ROADS}, h AS (SELECT CAST(round_even(x0 / 100, 0) AS BIGINT) * 2147483648 + CAST(round_even(y0 / 100, 0) AS BIGINT) AS p, CAST(round_even(x1 / 100, 0) AS BIGINT) * 2147483648 + CAST(round_even(y1 / 100, 0) AS BIGINT) AS q,
  sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length, least(CAST(floor(((degrees(atan2(y1 - y0, x1 - x0)) % 180) + 180) % 180 / 15) AS BIGINT), 11) AS bin,
  round_even(x0 / 100, 0) * 100 AS px, round_even(y0 / 100, 0) * 100 AS py, round_even(x1 / 100, 0) * 100 AS qx, round_even(y1 / 100, 0) * 100 AS qy FROM s WHERE upper(trim(kind)) <> '{EXCLUDED}'),
g AS (SELECT least(p, q) AS a, greatest(p, q) AS b, min(length) AS length, arg_min(bin, (length, bin)) AS bin FROM h WHERE p <> q AND length > 0 GROUP BY 1, 2),
y AS (SELECT a, b, length FROM g UNION ALL SELECT b, a, length FROM g),
v AS (SELECT DISTINCT node, x, y FROM (SELECT p AS node, px AS x, py AS y FROM h WHERE p <> q AND length > 0 UNION ALL SELECT q, qx, qy FROM h WHERE p <> q AND length > 0))"""
COSTS = [150.0, 250.0]


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.graph_edges(network.exclude_types(roads(spark, sf_dir), "kind", [EXCLUDED]), SNAP)


def _squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"x0": F.col("x") - 20, "y0": F.col("y") - 20, "x1": F.col("x") + 20, "y1": F.col("y") + 20}
    return supplies(spark, sf_dir).select("supply_id", "capacity", *[c.alias(k) for k, c in at.items()])


_ACCESS = f"""WITH RECURSIVE {_GRAPH}, {ACCESS},
o AS (SELECT a.origin_id, any_value(population) AS population, min(sqrt((a.x - v.x) * (a.x - v.x) + (a.y - v.y) * (a.y - v.y))) AS snap, arg_min(node, (sqrt((a.x - v.x) * (a.x - v.x) + (a.y - v.y) * (a.y - v.y)), node)) AS node FROM a, v GROUP BY 1),
z AS (SELECT u.supply_id, capacity, node, sqrt(pow(greatest(u.x - 20 - v.x, 0, v.x - u.x - 20), 2) + pow(greatest(u.y - 20 - v.y, 0, v.y - u.y - 20), 2)) AS snap FROM u, v),
w AS (SELECT supply_id, any_value(capacity) AS capacity, min(snap) AS snap, arg_min(node, (snap, node)) AS node FROM z GROUP BY 1),
r AS (SELECT supply_id, node, snap AS cost FROM w WHERE snap <= 60 UNION SELECT r.supply_id, y.b, r.cost + y.length FROM r JOIN y ON y.a = r.node WHERE r.cost + y.length <= 250),
c AS (SELECT supply_id, node, min(cost) AS cost FROM r GROUP BY 1, 2),
k AS (SELECT o.origin_id, w.supply_id, population, capacity, l.limit_ FROM c JOIN o ON o.node = c.node AND o.snap <= 60 JOIN w ON w.supply_id = c.supply_id, (VALUES (150.0::DOUBLE), (250.0::DOUBLE)) l(limit_) WHERE c.cost + o.snap <= l.limit_),
d AS (SELECT limit_, supply_id, max(capacity) / sum(population) AS ratio, sum(population) AS demand FROM k GROUP BY 1, 2 HAVING sum(population) > 0),
e AS (SELECT origin_id, k.limit_, sum(ratio) AS access, count(*) AS supplies, sum(capacity) AS supply_area FROM k JOIN d ON d.limit_ = k.limit_ AND d.supply_id = k.supply_id GROUP BY 1, 2),
f AS (SELECT o.origin_id, l.limit_ AS cost, o.population, o.snap, o.snap <= 60 AS available, CASE WHEN o.snap <= 60 THEN coalesce(access, 0) END AS access, CASE WHEN o.snap <= 60 THEN coalesce(supplies, 0) END AS supplies, CASE WHEN o.snap <= 60 THEN coalesce(supply_area, 0) END AS supply_area
  FROM o CROSS JOIN (VALUES (150.0::DOUBLE), (250.0::DOUBLE)) l(limit_) LEFT JOIN e ON e.origin_id = o.origin_id AND e.limit_ = l.limit_)"""


def _network_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = ranking.cut(_graph(spark, sf_dir))
    return access.network_catchment(edges, network.graph_nodes(edges, SNAP), origins(spark, sf_dir).select("origin_id", "x", "y", "population"), _squares(spark, sf_dir), COSTS, 60.0)


@query(f"{_ACCESS} SELECT origin_id, cost, round(population, 4) AS population, round(snap, 6) AS snap, available, round(access, 6) AS access, supplies, round(supply_area, 3) AS supply_area, round(ln(1 + access), 6) AS access_log1p FROM f")
def network_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-step access over the network: both snaps count, origins off the network have null."""
    out = _network_access(spark, sf_dir).select("origin_id", "cost", "population", "snap", "available", "access", "supplies", "supply_area", "access_log1p")
    return rounded(rounded(rounded(out, "snap", "access", "access_log1p"), "population", digits=4), "supply_area", digits=3)


@query(f"""{_ACCESS}, n AS (SELECT w.*, l.limit_, demand, ratio FROM w CROSS JOIN (VALUES (150.0::DOUBLE), (250.0::DOUBLE)) l(limit_) LEFT JOIN d ON d.supply_id = w.supply_id AND d.limit_ = l.limit_)
SELECT supply_id, limit_ AS cost, round(capacity, 3) AS capacity, round(snap, 6) AS snap, snap <= 60 AS available, CASE WHEN snap <= 60 THEN round(coalesce(demand, 0), 3) END AS demand, round(ratio, 6) AS ratio FROM n""")
def supply_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supply's snap, catchment population and ratio per cost; null where it is off the network, no ratio without population."""
    edges = ranking.cut(_graph(spark, sf_dir))
    found = access.network_supplies(edges, network.graph_nodes(edges, SNAP), origins(spark, sf_dir).select("origin_id", "x", "y", "population"), _squares(spark, sf_dir), COSTS, 60.0)
    out = found.select("supply_id", "cost", "capacity", "snap", F.col("node").isNotNull().alias("available"), "demand", "ratio")
    return rounded(rounded(out, "snap", "ratio"), "capacity", "demand", digits=3)


_REACH = """f AS (SELECT DISTINCT a AS node FROM y WHERE a % 50 = 0),
r AS (SELECT node AS source, node, 0.0::DOUBLE AS cost FROM f UNION SELECT r.source, y.b, r.cost + y.length FROM r JOIN y ON y.a = r.node WHERE r.cost + y.length <= 250), m AS (SELECT source, node, min(cost) AS cost FROM r GROUP BY 1, 2)"""


def _sources(edges: DataFrame) -> DataFrame:
    """The query set of the searches: nodes whose number is divisible by 50."""
    return edges.select(F.explode(F.array("a", "b")).alias("source")).distinct().filter("source % 50 = 0")


@query(f"WITH RECURSIVE {_GRAPH}, {_REACH} SELECT source, node, round(cost, 6) AS cost FROM m")
def network_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)
    return rounded(network.reach(edges, _sources(edges), 250.0), "cost")


@query(f"""WITH RECURSIVE {_GRAPH}, {_REACH}, x AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM g UNION ALL SELECT b FROM g) GROUP BY 1),
l AS (SELECT source, node, v.limit_ - cost AS rest, v.limit_ FROM m, (VALUES (150.0::DOUBLE), (250.0::DOUBLE)) v(limit_) WHERE cost <= v.limit_),
e AS (SELECT l.source, l.limit_, g.a, g.b, g.bin, least(any_value(g.length), sum(l.rest)) AS part FROM g JOIN l ON l.node = g.a OR l.node = g.b GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT source, limit_, bin, sum(part) AS n, count(*) AS k FROM e WHERE part > 0 GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY source, limit_) AS p FROM b),
t AS (SELECT source, limit_, sum(n) AS service_length, CAST(sum(k) AS BIGINT) AS service_edges, -sum(p * ln(p)) / ln(12.0) AS entropy, max(p) AS dominant_share FROM p GROUP BY 1, 2),
n AS (SELECT source, limit_, count(*) AS service_nodes, CAST(sum(CASE WHEN degree >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS intersections, CAST(sum(CASE WHEN degree = 1 THEN 1 ELSE 0 END) AS BIGINT) AS dead_ends, avg(degree) AS mean_degree FROM l JOIN x ON x.node = l.node GROUP BY 1, 2)
SELECT n.source, n.limit_ AS "limit", round(coalesce(service_length, 0), 4) AS service_length, coalesce(service_edges, 0) AS service_edges, service_nodes, intersections, dead_ends, round(intersections / (service_length / 1000), 6) AS intersections_per_km,
  round(dead_ends / (service_length / 1000), 6) AS dead_ends_per_km, round(mean_degree, 6) AS mean_degree, round(entropy, 6) AS entropy, round(dominant_share, 6) AS dominant_share FROM n LEFT JOIN t ON t.source = n.source AND t.limit_ = n.limit_""")
def service_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _graph(spark, sf_dir)
    out = network.service_area(edges, network.reach(edges, _sources(edges), 250.0), COSTS)
    return rounded(rounded(out, "service_length", digits=4), "intersections_per_km", "dead_ends_per_km", "mean_degree", "entropy", "dominant_share")


@query(f"""WITH RECURSIVE {_GRAPH}, r(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM y UNION SELECT y.b, min(r.root) FROM r JOIN y ON y.a = r.node JOIN recurring.r AS c ON c.node = y.b WHERE r.root < c.root GROUP BY 1) SELECT node, root FROM r""")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the street graph, named by their smallest node."""
    return network.components(_graph(spark, sf_dir))


@query(f"""WITH {ROADS}, b AS (SELECT s.*, unnest(range(CAST(floor(least(y0, y1) / 500) AS BIGINT), CAST(floor(greatest(y0, y1) / 500) AS BIGINT) + 1)) AS r FROM s),
c AS (SELECT *, unnest(range(CAST(floor(least(x0, x1) / 500) AS BIGINT), CAST(floor(greatest(x0, x1) / 500) AS BIGINT) + 1)) AS c FROM b),
j AS (SELECT DISTINCT m.id, o.id AS other, m.x0, m.y0, m.x1 - m.x0 AS rx, m.y1 - m.y0 AS ry, o.x1 - o.x0 AS sx, o.y1 - o.y0 AS sy, o.x0 - m.x0 AS qx, o.y0 - m.y0 AS qy FROM c m JOIN c o ON m.r = o.r AND m.c = o.c AND m.id <> o.id
  WHERE least(m.x0, m.x1) <= greatest(o.x0, o.x1) AND least(o.x0, o.x1) <= greatest(m.x0, m.x1) AND least(m.y0, m.y1) <= greatest(o.y0, o.y1) AND least(o.y0, o.y1) <= greatest(m.y0, m.y1)),
t AS (SELECT id, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS u FROM j WHERE rx * sy - ry * sx <> 0
  UNION ALL SELECT id, (qx * rx + qy * ry) / (rx * rx + ry * ry), 0 FROM j WHERE rx * sy - ry * sx = 0 AND qx * ry - qy * rx = 0 AND rx * rx + ry * ry > 0
  UNION ALL SELECT id, ((qx + sx) * rx + (qy + sy) * ry) / (rx * rx + ry * ry), 0 FROM j WHERE rx * sy - ry * sx = 0 AND qx * ry - qy * rx = 0 AND rx * rx + ry * ry > 0),
k AS (SELECT DISTINCT id, t FROM t WHERE t > 0 AND t < 1 AND u >= 0 AND u <= 1 UNION SELECT id, 0 FROM s UNION SELECT id, 1 FROM s),
n AS (SELECT k.id, t, lead(t) OVER (PARTITION BY k.id ORDER BY t) AS t2, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy FROM k JOIN s ON s.id = k.id),
e AS (SELECT round_even((x0 + t * dx) / 10, 0) * 10 AS ax, round_even((y0 + t * dy) / 10, 0) * 10 AS ay, round_even((x0 + t2 * dx) / 10, 0) * 10 AS bx, round_even((y0 + t2 * dy) / 10, 0) * 10 AS by_ FROM n WHERE t2 IS NOT NULL),
g AS (SELECT CAST(round_even(ax / 10, 0) AS BIGINT) * 2147483648 + CAST(round_even(ay / 10, 0) AS BIGINT) AS p, CAST(round_even(bx / 10, 0) AS BIGINT) * 2147483648 + CAST(round_even(by_ / 10, 0) AS BIGINT) AS q, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS length FROM e)
SELECT least(p, q) AS a, greatest(p, q) AS b, round(min(length), 6) AS length FROM g WHERE p <> q GROUP BY 1, 2""")
def planar_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the street graph with a node at every crossing and every end."""
    return rounded(network.planar_edges(roads(spark, sf_dir), 10.0, SIZE), "length")


@query("""WITH f AS (SELECT p_partkey AS seq, ['way', 'relation'][1 + p_partkey % 2] AS osm_type, p_partkey // 4 AS osm_id, CASE WHEN p_partkey % 3 <> 0 THEN 'Leisure' ELSE 'landuse' END AS k, ['Park', 'garden', 'pitch'][1 + p_partkey % 3] AS v, CASE WHEN p_partkey % 7 = 0 THEN 'Private' WHEN p_partkey % 11 = 0 THEN 'yes' END AS acc, p_size * 100.0::DOUBLE - 500 AS area FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY osm_type, osm_id ORDER BY seq) AS n FROM f WHERE lower(k) = 'leisure' AND lower(v) IN ('park', 'garden') AND coalesce(lower(acc), '') NOT IN ('private', 'no') AND area > 0)
SELECT osm_type || '/' || osm_id AS supply_id, lower(v) AS green_type, area AS capacity, seq FROM o WHERE n = 1""")
def green_supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tags = F.from_json(F.when(k % 7 == 0, '{"access": "Private"}').when(k % 11 == 0, '{"access": "yes"}').otherwise("{}"), "map<string,string>")
    kinds = F.element_at(F.array(F.lit("Park"), F.lit("garden"), F.lit("pitch")), (k % 3 + 1).cast("int"))
    features = table(spark, sf_dir, "part").select(
        k.alias("seq"), F.when(k % 2 == 0, "way").otherwise("relation").alias("osm_type"), F.floor(k / 4).alias("osm_id"), F.when(k % 3 != 0, "Leisure").otherwise("landuse").alias("matched_key"),
        kinds.alias("matched_value"), tags.alias("tags"), (F.col("p_size") * 100.0 - 500).alias("area"),
    )
    return access.green_supplies(features, ["park", "garden"])


def _ring(*corners) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


_ELLS = """n AS (SELECT n_nationkey AS region, (n_nationkey % 5) * 1000.0::DOUBLE + 130 AS x, (n_nationkey // 5) * 1000.0::DOUBLE - 170 AS y FROM nation),
b AS (SELECT region, x AS x0, y AS y0, x + 800 AS x1, y + 300 AS y1 FROM n UNION ALL SELECT region, x, y + 300, x + 200, y + 700 FROM n)"""


def _ells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An L of 800 by 700 per nation, on a raster of 1000; it is no rectangle and not convex."""
    k = F.col("n_nationkey")
    x, y = (k % 5) * 1000.0 + 130, F.floor(k / 5) * 1000.0 - 170
    ring = _ring((x, y), (x + 800, y), (x + 800, y + 300), (x + 200, y + 300), (x + 200, y + 700), (x, y + 700))
    return table(spark, sf_dir, "nation").select(k.alias("region"), F.col("n_regionkey").alias("ord"), F.array(ring).alias("rings"))


@query(f"""WITH {_ELLS}, c AS (SELECT r.range AS row_id, c.range AS col_id, c.range * 250.0::DOUBLE AS x0, r.range * 250.0::DOUBLE - 250 AS y0 FROM range(40) r, range(40) c),
a AS (SELECT row_id, col_id, c.x0, c.y0, sum((least(c.x0 + 250, b.x1) - greatest(c.x0, b.x0)) * (least(c.y0 + 250, b.y1) - greatest(c.y0, b.y0))) AS area FROM c JOIN b ON b.x0 < c.x0 + 250 AND b.x1 > c.x0 AND b.y0 < c.y0 + 250 AND b.y1 > c.y0 GROUP BY 1, 2, 3, 4)
SELECT printf('g250_%05d_%05d', row_id, col_id) AS grid_id, row_id, col_id, x0, y0, x0 + 250 AS x1, y0 + 250 AS y1, 62500.0::DOUBLE AS cell_area_m2, round(area, 4) AS fua_area_m2, round(area / 62500, 6) AS fua_ratio, CASE WHEN area / 62500 >= 0.5 THEN 1 ELSE 0 END AS eligible_core FROM a WHERE area / 62500 > 0.1""")
def boundary_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(boundary.boundary_grid(_ells(spark, sf_dir), SIZE, 0.1), "fua_area_m2", digits=4), "fua_ratio")


@query("""WITH n AS (SELECT n_nationkey AS region FROM nation) SELECT region, 320000.0::DOUBLE AS area, 3000.0::DOUBLE AS perimeter, round((region % 5) * 1000.0 + 130 + (240000 * 400.0 + 80000 * 100.0) / 320000, 4) AS cx, round((region // 5) * 1000.0 - 170 + (240000 * 150.0 + 80000 * 500.0) / 320000, 4) AS cy,
  (region % 5) * 1000.0::DOUBLE + 130 AS x0, (region // 5) * 1000.0::DOUBLE - 170 AS y0, (region % 5) * 1000.0::DOUBLE + 930 AS x1, (region // 5) * 1000.0::DOUBLE + 530 AS y1 FROM n""")
def region_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(boundary.region_areas(_ells(spark, sf_dir), "region"), "area", "perimeter", "cx", "cy", digits=4)


#: Regions that overlap: the L of each nation, and a square of 1000 over every fifth.
_HELD = f"""WITH {_ELLS}, {ACCESS}, q AS (SELECT region, x0, y0, x1, y1 FROM b UNION ALL SELECT 100 + region, x - 130, y + 170, x + 870, y + 1170 FROM n WHERE region % 5 = 0),
i AS (SELECT a.origin_id, q.region, max(CASE WHEN a.x > x0 AND a.x < x1 AND a.y > y0 AND a.y < y1 OR (q.region < 100 AND a.y = y1 AND y1 - y0 = 300 AND a.x > x0 AND a.x < x0 + 200) THEN 1 ELSE 0 END) AS within FROM a JOIN q ON a.x >= x0 AND a.x <= x1 AND a.y >= y0 AND a.y <= y1 GROUP BY 1, 2)"""


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    y = F.floor(k / 5) * 1000.0
    zero, thousand = F.lit(0.0), F.lit(1000.0)
    squares = table(spark, sf_dir, "nation").filter(k % 5 == 0).select((k + 100).alias("region"), (F.col("n_regionkey") + 10).alias("ord"), F.array(_ring((zero, y), (thousand, y), (thousand, y + 1000), (zero, y + 1000))).alias("rings"))
    return _ells(spark, sf_dir).unionByName(squares)


@query(f"""{_HELD}, m AS (SELECT *, row_number() OVER (PARTITION BY origin_id ORDER BY 1 - within, CASE WHEN region < 100 THEN 320000 ELSE 1000000 END, region) AS k FROM i) SELECT a.origin_id, m.region, CAST(m.within AS INTEGER) AS within FROM a LEFT JOIN m ON m.origin_id = a.origin_id AND k = 1""")
def smallest_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.smallest_polygon(origins(spark, sf_dir), "origin_id", _overlapping(spark, sf_dir), "region", float(SIZE))


@query(f"""{_HELD}, m AS (SELECT i.*, row_number() OVER (PARTITION BY origin_id ORDER BY CASE WHEN region >= 100 THEN r.n_regionkey + 10 ELSE r.n_regionkey END, region) AS k FROM i JOIN nation r ON r.n_nationkey = region % 100 WHERE within = 1) SELECT a.origin_id, coalesce(CAST(m.region AS VARCHAR), 'unknown') AS region FROM a LEFT JOIN m ON m.origin_id = a.origin_id AND k = 1""")
def first_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.first_region(origins(spark, sf_dir), "origin_id", _overlapping(spark, sf_dir), "region", "ord", float(SIZE))


_SQUARES = "sq AS (SELECT n_nationkey AS region, n_regionkey AS ord, 0.0::DOUBLE AS x0, (n_nationkey // 5) * 1000.0::DOUBLE AS y0, 1000.0::DOUBLE AS x1, (n_nationkey // 5) * 1000.0::DOUBLE + 1000 AS y1 FROM nation WHERE n_nationkey % 5 = 0)"


@query(f"""WITH {_ELLS}, {_SQUARES}, r AS (SELECT n_regionkey AS ord, x0, y0, x1, y1 FROM b JOIN nation ON n_nationkey = region UNION ALL SELECT ord + 10, x0, y0, x1, y1 FROM sq UNION ALL SELECT n_regionkey + 10, x0, y0, x1, y1 FROM b JOIN nation ON n_nationkey = region WHERE region % 5 = 0),
c AS (SELECT ord, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT), 10)) AS x, y0, y1 FROM r), d AS (SELECT DISTINCT ord, x, y FROM (SELECT ord, x, unnest(range(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT), 10)) AS y FROM c)) SELECT ord, count(*) * 100.0::DOUBLE AS area FROM d GROUP BY 1""")
def dissolved_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of polygons dissolved by a key, some of which overlap."""
    both = _overlapping(spark, sf_dir)
    again = _ells(spark, sf_dir).filter("region % 5 = 0").withColumn("ord", F.col("ord") + 10)
    return rounded(overlay.dissolved_area(both.unionByName(again), float(SIZE), "ord"), "area", digits=4)


@query(f"""WITH {_ELLS}, {_SQUARES}, p AS (SELECT b.region, sum(greatest(0, least(b.x1, sq.x1) - greatest(b.x0, sq.x0)) * greatest(0, least(b.y1, sq.y1) - greatest(b.y0, sq.y0))) AS area FROM b, sq GROUP BY 1),
s AS (SELECT o_custkey % 25 AS k, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS accuracy FROM orders GROUP BY 1) SELECT region, round(area, 4) AS area, coalesce(n, 0) AS n, round(accuracy, 6) AS accuracy, CASE WHEN coalesce(n, 0) >= 5 THEN 1 ELSE 0 END AS reliable FROM p LEFT JOIN s ON k = region WHERE area > 0""")
def clipped_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions clipped to the study area, with what is known of each and whether that is enough."""
    study = _overlapping(spark, sf_dir).filter("region >= 100")
    inside = overlay.clipped_area(_ells(spark, sf_dir), "region", study, float(SIZE))
    own = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("region")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("accuracy"))
    return rounded(rounded(boundary.reliable_regions(inside, own, "region"), "area", digits=4), "accuracy")


@query("""WITH k AS (SELECT p_partkey AS k, row_number() OVER (PARTITION BY p_partkey * 7919 % 50, p_partkey * 104729 % 40 ORDER BY p_partkey) AS n, p_partkey * 7919 % 50 AS x, p_partkey * 104729 % 40 AS y FROM part) SELECT x, y, k AS p_partkey FROM k WHERE n = 1""")
def first_per_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return boundary.first_per_place(table(spark, sf_dir, "part").select(k, (k * 7919 % 50).alias("x"), (k * 104729 % 40).alias("y")), ["p_partkey"], "p_partkey")


@query("""WITH s AS (SELECT o_custkey % 25 AS k, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS accuracy FROM orders WHERE o_custkey % 25 > 2 GROUP BY 1) SELECT n_nationkey AS region, coalesce(n, 0) AS n, round(accuracy, 6) AS accuracy, CASE WHEN coalesce(n, 0) >= 5 THEN 1 ELSE 0 END AS reliable FROM nation LEFT JOIN s ON k = n_nationkey""")
def reliable_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("region"), (F.col("o_orderstatus") == "F").cast("double").alias("ok")).filter("region > 2")
    stats = own.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accuracy"))
    return rounded(boundary.reliable_regions(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region")), stats, "region"), "accuracy")


@query(f"""WITH {ACCESS}, a1 AS (SELECT * FROM a ORDER BY population DESC, origin_id LIMIT 1), b AS (SELECT a.* FROM a, a1 WHERE sqrt(pow(a.x - a1.x, 2) + pow(a.y - a1.y, 2)) >= 500), a2 AS (SELECT * FROM b ORDER BY population DESC, origin_id LIMIT 1),
d AS (SELECT b.* FROM b, a2 WHERE sqrt(pow(b.x - a2.x, 2) + pow(b.y - a2.y, 2)) >= 500), a3 AS (SELECT * FROM d ORDER BY population DESC, origin_id LIMIT 1)
SELECT origin_id, x, y, population AS score, 1::BIGINT AS position FROM a1 UNION ALL SELECT origin_id, x, y, population, 2 FROM a2 UNION ALL SELECT origin_id, x, y, population, 3 FROM a3""")
def separated_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three richest origins at least 500 apart."""
    return boundary.separated(origins(spark, sf_dir).select("origin_id", "x", "y", "population"), "origin_id", F.col("population"), 3, 500.0)


@query()
def spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight origins of each zone at least 800 apart, filled up from the others; tested against a greedy loop in plain Python."""
    return boundary.spaced_sample(origins(spark, sf_dir), "zone", "origin_id", 8, 800.0)


@query(f"""WITH {ROADS}, k AS (SELECT * FROM s WHERE kind = '1-URGENT' AND y0 < 1200), cells AS (SELECT r.range AS row_id, c.range AS col_id, c.range * 250.0::DOUBLE AS cx, r.range * 250.0::DOUBLE AS cy FROM range(20) r, range(20) c),
p AS (SELECT row_id, col_id, cx + dx AS px, cy + dy AS py FROM cells, (VALUES (0, 0), (250, 0), (0, 250), (250, 250)) v(dx, dy)),
t AS (SELECT row_id, col_id, px, py, x0, y0, x1, y1, CASE WHEN (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) > 0 THEN least(greatest(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 0), 1) ELSE 0 END AS t FROM p, k),
c AS (SELECT row_id, col_id, min(sqrt((px - x0 - t * (x1 - x0)) * (px - x0 - t * (x1 - x0)) + (py - y0 - t * (y1 - y0)) * (py - y0 - t * (y1 - y0)))) AS d FROM t GROUP BY 1, 2),
e AS (SELECT row_id, col_id, cx, cy, x, y FROM cells, (SELECT x0 AS x, y0 AS y FROM k UNION ALL SELECT x1, y1 FROM k)), f AS (SELECT row_id, col_id, min(sqrt(pow(greatest(cx - x, 0, x - cx - 250), 2) + pow(greatest(cy - y, 0, y - cy - 250), 2))) AS d FROM e GROUP BY 1, 2),
i AS (SELECT DISTINCT row_id, col_id FROM (SELECT row_id, col_id, CASE WHEN x1 = x0 THEN CASE WHEN x0 BETWEEN cx AND cx + 250 THEN 0.0 ELSE 2.0 END ELSE least((cx - x0) / (x1 - x0), (cx + 250 - x0) / (x1 - x0)) END AS ax, CASE WHEN x1 = x0 THEN CASE WHEN x0 BETWEEN cx AND cx + 250 THEN 1.0 ELSE -1.0 END ELSE greatest((cx - x0) / (x1 - x0), (cx + 250 - x0) / (x1 - x0)) END AS bx,
  CASE WHEN y1 = y0 THEN CASE WHEN y0 BETWEEN cy AND cy + 250 THEN 0.0 ELSE 2.0 END ELSE least((cy - y0) / (y1 - y0), (cy + 250 - y0) / (y1 - y0)) END AS ay, CASE WHEN y1 = y0 THEN CASE WHEN y0 BETWEEN cy AND cy + 250 THEN 1.0 ELSE -1.0 END ELSE greatest((cy - y0) / (y1 - y0), (cy + 250 - y0) / (y1 - y0)) END AS by_ FROM cells, k) WHERE greatest(0.0, ax, ay) <= least(1.0, bx, by_)),
d AS (SELECT c.row_id, c.col_id, CASE WHEN i.row_id IS NOT NULL THEN 0 ELSE least(c.d, f.d) END AS distance FROM c JOIN f ON f.row_id = c.row_id AND f.col_id = c.col_id LEFT JOIN i ON i.row_id = c.row_id AND i.col_id = c.col_id)
SELECT row_id, col_id, round(distance, 6) AS distance, CASE WHEN distance <= 0 THEN 'shoreline_cell' WHEN distance <= 500 THEN 'coastal_0_500m' WHEN distance <= 1000 THEN 'coastal_500_1000m' WHEN distance <= 2000 THEN 'coastal_1_2km' WHEN distance <= 5000 THEN 'transition_2_5km' ELSE 'inland_5km_plus' END AS band FROM d""")
def coast_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each cell to the shore (here the urgent roads that start below 1200) and its band; cells that the shore crosses have 0."""
    shore = roads(spark, sf_dir).filter("kind = '1-URGENT' AND y0 < 1200").select("id", "x0", "y0", "x1", "y1")
    cells = lattice.grid_cells(spark, 20, 20, SIZE)
    return rounded(access.shore_distance(cells, shore, SIZE).select("row_id", "col_id", "distance", "band"), "distance")

