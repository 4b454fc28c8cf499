"""Queries of panel tables, set checks and remaining scalar rules."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import scalar as S
from latticework.operators import lattice, morphology, panels, selection

from .inputs import ACCESS, BUILDINGS, CELL, CELL_AREA, COLS, PIXELS, PREDICTIONS, ROWS, SIZE, buildings, origins, pixels, predictions, rounded, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {PREDICTIONS}, s AS (SELECT * FROM q WHERE true_label IN ('A', 'N') AND probability >= 0.95), f AS (SELECT true_label FROM s GROUP BY 1 HAVING count(*) >= 100) SELECT true_label, fold, count(*) AS n FROM s WHERE true_label IN (SELECT true_label FROM f) GROUP BY 1, 2")
def modelling_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.modelling_population(predictions(spark, sf_dir), "true_label", "probability", ["A", "N"], 0.95).groupBy("true_label", "fold").agg(F.count(F.lit(1)).alias("n"))


def _kinds(column: str) -> str:
    return ", ".join(f"CAST(sum(CASE WHEN label = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{k}\"" for k in KINDS)


KINDS = ["click", "view", "purchase", "signup"]


@query(f"""WITH {PIXELS}, cells AS (SELECT r.range AS row_id, c.range AS col_id FROM range(20) r, range(20) c) SELECT c.row_id, c.col_id, {_kinds('label')} FROM cells c LEFT JOIN e ON e.row_id = c.row_id AND e.col_id = c.col_id GROUP BY 1, 2""")
def context_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = lattice.point_cell(pixels(spark, sf_dir), "x", "y", SIZE, ROWS, COLS)
    return panels.context_pivot(zones, lattice.grid_cells(spark, ROWS, COLS), CELL, "label", KINDS, F.lit(1))


@query(f"""WITH {ACCESS}, {BUILDINGS.split('),' + chr(10) + 'o AS')[0]}), m AS (SELECT origin_id, b.id, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY origin_id ORDER BY (x1 - x0) * (y1 - y0), b.id) AS k FROM a JOIN b ON x >= x0 AND x <= x1 AND y >= y0 AND y <= y1)
SELECT a.origin_id, m.id AS region, m.area FROM a LEFT JOIN m ON m.origin_id = a.origin_id AND k = 1""")
def point_in_region_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.smallest_region(origins(spark, sf_dir), buildings(spark, sf_dir), "origin_id", SIZE)


@query(f"WITH {PREDICTIONS} SELECT model, fold, count(*) AS n, round(avg(1 - probability), 6) AS mean, round(stddev_samp(1 - probability), 6) AS sd, round(quantile_cont(1 - probability, 0.95), 6) AS q95, round(avg(CASE WHEN true_label <> predicted_label THEN 1.0 ELSE 0 END), 6) AS disagreement FROM q GROUP BY 1, 2")
def warning_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels.warning_scores(predictions(spark, sf_dir), ["model", "fold"]), "mean", "sd", "q95", "disagreement")


@query("SELECT CASE WHEN l.doc_id % 4 <> 0 THEN quality END AS quality, lang, count(*) AS n, round(avg(n_chars), 6) AS confidence FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2")
def audit_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("quality", F.when(F.col("doc_id") % 4 != 0, F.col("quality")))
    return rounded(panels.crosswalk(both, "quality", "lang", "n_chars"), "confidence")


@query(f"WITH {PREDICTIONS} SELECT fold, CAST(sum(CASE WHEN true_label = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS \"A\", CAST(sum(CASE WHEN true_label = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS \"N\", CAST(sum(CASE WHEN true_label = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS \"R\" FROM q GROUP BY 1")
def fold_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.composition(predictions(spark, sf_dir), "fold", "true_label", ["A", "N", "R"])


@query("SELECT l_returnflag AS g, round(avg(CASE WHEN l_discount - l_tax > 1e-9 THEN 1.0 ELSE 0 END), 6) AS gain, round(avg(CASE WHEN l_discount - l_tax < -1e-9 THEN 1.0 ELSE 0 END), 6) AS loss, round(avg(CASE WHEN abs(l_discount - l_tax) <= 1e-9 THEN 1.0 ELSE 0 END), 6) AS flat FROM lineitem GROUP BY 1")
def change_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels.change_shares(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g"), "l_tax", "l_discount", ["g"]), "gain", "loss", "flat")


@query("SELECT o_custkey AS site, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, round(sum(o_totalprice), 3) AS o_totalprice, max(o_orderpriority) AS o_orderpriority, count(*) AS rows FROM orders GROUP BY 1")
def collapse_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(panels.collapse(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "site"), "site", ["o_orderstatus"], ["o_totalprice"], ["o_orderpriority"], "o_orderkey"), "o_totalprice", digits=3)


@query("""WITH a AS (SELECT c_nationkey AS zone, count(*) AS n, sum(c_acctbal) AS s FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS zone, count(*) AS n, sum(s_acctbal) AS s FROM supplier GROUP BY 1)
SELECT a.zone, a.n AS left_n, round(a.s, 3) AS left_sum, coalesce(b.n, 0) AS right_n, round(coalesce(b.s, 0), 3) AS right_sum, round(coalesce(b.n, 0) / CAST(a.n AS DOUBLE), 6) AS ratio FROM a LEFT JOIN b ON a.zone = b.zone""")
def district_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("zone"), F.col("c_acctbal").alias("v"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("zone"), F.col("s_acctbal").alias("v"))
    return rounded(rounded(panels.compare_counts(left, right, "zone", "v"), "left_sum", "right_sum", digits=3), "ratio")


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS both, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_first, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_second")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.key_sets(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n FROM lineitem) WHERE n > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.repeated(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_partkey"])


@query("SELECT p_partkey, kind FROM (SELECT p_partkey, p_size % 6 AS kind, row_number() OVER (PARTITION BY p_size % 6 ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS k FROM part) WHERE k <= 20")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.capped_sample(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6).alias("kind")), "kind", "p_partkey", 20)


@query(r"""WITH c AS (SELECT unnest(regexp_extract_all(text, '([a-z]+)\.', 1)) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM c GROUP BY 1), k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '([a-z]+)\.', 1)) AS word FROM benchmark) SELECT n.word, n, CASE WHEN k.word IS NULL THEN 0 ELSE 1 END AS known FROM n LEFT JOIN k ON k.word = n.word""")
def cited_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"([a-z]+)\."
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("word"))
    return panels.citations(table(spark, sf_dir, "documents"), "text", pattern, known, "word")


@query("""WITH q AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag AS g, l_orderkey * 10 + l_linenumber AS id, round(least(greatest((l_extendedprice - a) / (b - a), 0), 1), 6) AS scaled FROM lineitem JOIN q ON q.g = l_returnflag""")
def percentile_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_extendedprice")
    return rounded(panels.scaled(own, "l_extendedprice", ["g"]).select("g", "id", "scaled"), "scaled")


@query("""WITH i AS (SELECT l_returnflag AS g, l_orderkey * 10 + l_linenumber AS id, l_quantity AS q, l_extendedprice AS e FROM lineitem), m AS (SELECT g, quantile_cont(q, 0.5) AS a, quantile_cont(e, 0.5) AS b, stddev_pop(q) AS sa, stddev_pop(e) AS sb FROM i GROUP BY 1),
s AS (SELECT i.g, id, pow((q - a) / sa, 2) + pow((e - b) / sb, 2) AS score FROM i JOIN m ON m.g = i.g WHERE id % 2 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score, id) AS k FROM s) SELECT g, id, round(score, 6) AS score FROM k WHERE k = 1""")
def medoid_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice")
    return rounded(selection.medoids(own, "g", ["l_quantity", "l_extendedprice"], "id", own.filter("id % 2 = 0")), "score")


@query("""WITH p AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS road_length, p_size * 40.0::DOUBLE AS buffer_area, p_partkey % 5 AS building_count, p_partkey % 7 * 100.0::DOUBLE AS building_area, p_partkey % 11 * 30.0::DOUBLE AS edge_length FROM part),
r AS (SELECT *, least(greatest(building_area / buffer_area, 0), 1) AS s, least(greatest(edge_length / (2 * road_length), 0), 1) AS c FROM p)
SELECT p_partkey, round(buffer_area / 62500, 6) AS buffer_coverage, round(s, 6) AS building_share, round(greatest(1 - s, 0), 6) AS open_share, round(building_count / (buffer_area / 10000), 6) AS building_density, round(edge_length / (road_length / 1000), 6) AS edge_per_km, round(c, 6) AS continuity, round(1 - c, 6) AS gap FROM r""")
def street_frontage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    own = table(spark, sf_dir, "part").select(k, (s * 10.0).alias("road_length"), (s * 40.0).alias("buffer_area"), (k % 5).alias("building_count"), (k % 7 * 100.0).alias("building_area"), (k % 11 * 30.0).alias("edge_length"))
    names = ["buffer_coverage", "building_share", "open_share", "building_density", "edge_per_km", "continuity", "gap"]
    return rounded(morphology.frontage(own, CELL_AREA).select("p_partkey", *names), *names)


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'airport' WHEN 1 THEN 'industrial_port' WHEN 2 THEN 'green_open' WHEN 3 THEN 'blue_water' WHEN 4 THEN 'military_quarry' ELSE 'other_context' END AS context_class, CASE WHEN event_id % 3 = 0 THEN NULL ELSE DATE '2026-06-01' END AS day, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS BIGINT) END AS prefix FROM events""")
def tag_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    tags = [("aeroway", "gate"), ("landuse", "industrial"), ("leisure", "park"), ("natural", "water"), ("landuse", "quarry"), ("name", "x")]
    text = F.element_at(F.array(*[F.lit('{"%s": "%s"}' % t) for t in tags]), (k % 6 + 1).cast("int"))
    day = F.when(k % 3 == 0, "2026-13-01").when(k % 3 == 1, "2026-6-1").otherwise("2026-06-01")
    label = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(" - x"))).otherwise("x")
    return table(spark, sf_dir, "events").select("event_id", S.tag_class(F.from_json(text, "map<string,string>")).alias("context_class"), S.iso_date(day).alias("day"), S.label_prefix(label).alias("prefix"))


#: Tags of a feature by its number, and what they make of it.
_TAGGED = [
    ({"landuse": "forest", "natural": "wood"}, ("green_open", "landuse", "forest")), ({"landuse": "grass", "harbour": "yes"}, ("industrial_port", "landuse", "grass")),
    ({"amenity": "bench", "railway": "station"}, ("transport_terminal", "amenity", "bench")), ({"shop": "bakery", "amenity": "school"}, ("commercial_retail", "shop", "bakery")),
    ({"aeroway": "apron", "man_made": "silo", "leisure": "park"}, ("airport", "aeroway", "apron")), ({"natural": "water", "name": "x"}, ("blue_water", "natural", "water")),
    ({"landuse": "railway", "natural": "cliff"}, ("construction_brownfield", "landuse", "railway")),
]


def _case(k: int) -> str:
    return "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{want[k]}'" for i, (_, want) in enumerate(_TAGGED)) + " END"


@query(f"SELECT event_id, {_case(0)} AS context_class, {_case(1)} AS matched_key, {_case(2)} AS matched_value FROM events")
def tag_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, key and value of features with several tags."""
    text = F.element_at(F.array(*[F.lit(json.dumps(t)) for t, _ in _TAGGED]), (F.col("event_id") % 7 + 1).cast("int"))
    own = table(spark, sf_dir, "events").select("event_id", S.tag_match(F.from_json(text, "map<string,string>")).alias("m"))
    return own.select("event_id", "m.context_class", "m.matched_key", "m.matched_value")


@query("""WITH p AS (SELECT p_partkey, p_size / 100.0::DOUBLE AS a FROM part), e AS (SELECT p_partkey, greatest(a, 1e-12) AS x, greatest(0.4 - a / 2, 1e-12) AS y, greatest(0.6 - a / 2, 1e-12) AS z FROM p) SELECT p_partkey, round(-(x * ln(x) + y * ln(y) + z * ln(z)) / ln(3), 6) AS entropy FROM e""")
def row_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("p_size") / 100.0
    return rounded(table(spark, sf_dir, "part").select("p_partkey", S.row_entropy(F.array(a, 0.4 - a / 2, 0.6 - a / 2)).alias("entropy")), "entropy")


@query(f"""WITH {ACCESS}, cells AS (SELECT r.range AS row_id, c.range AS col_id, c.range * 250.0::DOUBLE + 125 AS cx, r.range * 250.0::DOUBLE + 125 AS cy FROM range(20) r, range(20) c)
SELECT row_id, col_id, count(*) AS n, round(sum(population), 3) AS population, round(count(*) / (pi() * 0.16), 4) AS density FROM cells JOIN a ON sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= 400 GROUP BY 1, 2""")
def reach_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within 400 m of each cell's centre, and their density over that circle."""
    cells = lattice.grid_cells(spark, ROWS, COLS).select(*CELL, (F.col("x0") + SIZE / 2).alias("x"), (F.col("y0") + SIZE / 2).alias("y"))
    pairs = lattice.near_pairs(cells, origins(spark, sf_dir), 400.0, CELL, ["population"])
    area = math.pi * 400.0**2
    out = pairs.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("r_population").alias("population"))
    return rounded(rounded(out, "population", digits=3).withColumn("density", F.col("n") / (area / 1e6)), "density", digits=4)
