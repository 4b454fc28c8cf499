"""Queries of feature sets, picks, panels and the audit gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import scalar as S
from latticework.operators import audit, evaluation, features, panels, profile, statistics, zonal

from .inputs import PREDICTIONS, predictions, rounded, table, wide

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CLASSES = ["F", "O", "P"]
METRICS = ["coverage", "height", "green"]
_CELLS = """c AS (SELECT o_orderkey AS grid_id, o_orderstatus AS class, o_orderpriority AS district, o_totalprice AS heat, (o_orderkey * 7919 % 997) / 10.0::DOUBLE AS coverage, (o_orderkey * 104729 % 991) / 10.0::DOUBLE AS height,
  CASE WHEN o_orderkey % 13 <> 0 THEN (o_custkey * 31 % 101) / 100.0::DOUBLE END AS green, 0.5 + (o_orderkey * 31 % 51) / 100.0::DOUBLE AS confidence, CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS core, CAST(o_orderkey % 4 AS BIGINT) AS buildings FROM orders)"""
_POOL = "p AS (SELECT * FROM c WHERE confidence >= 0.8 AND core = 1 AND buildings > 0 AND green IS NOT NULL)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells with a class, a district and metrics."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("grid_id"), F.col("o_orderstatus").alias("class"), F.col("o_orderpriority").alias("district"), F.col("o_totalprice").alias("heat"), (k * 7919 % 997 / 10.0).alias("coverage"), (k * 104729 % 991 / 10.0).alias("height"),
        F.when(k % 13 != 0, F.col("o_custkey") * 31 % 101 / 100.0).alias("green"), (F.lit(0.5) + k * 31 % 51 / 100.0).alias("confidence"), F.when(k % 3 != 0, 1).otherwise(0).alias("core"), (k % 4).cast("long").alias("buildings"),
    )


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.complete_cases(cells(spark, sf_dir), METRICS, F.col("confidence") >= 0.8, F.col("core") == 1, F.col("buildings") > 0)


@query(f"WITH {_CELLS}, {_POOL} SELECT class, count(*) AS n, round(avg(coverage), 6) AS coverage FROM p GROUP BY 1")
def tile_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_pool(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.avg("coverage").alias("coverage")), "coverage")


@query(f"WITH {_CELLS} SELECT grid_id, class FROM c WHERE heat >= 150000 AND buildings >= 2 AND green > 0")
def qa_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.complete_cases(cells(spark, sf_dir), ["green"], F.col("heat") >= 150000, F.col("buildings") >= 2, F.col("green") > 0).select("grid_id", "class")


@query(f"WITH {_CELLS} SELECT class, CAST(sum(core) AS BIGINT) AS eligible, CAST(count(*) - sum(core) AS BIGINT) AS excluded FROM c GROUP BY 1")
def eligible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cells(spark, sf_dir).groupBy("class").agg(F.sum("core").cast("long").alias("eligible"), F.count(F.lit(1)).alias("n"))
    return out.select("class", "eligible", (F.col("n") - F.col("eligible")).alias("excluded"))


@query(f"""WITH {_CELLS}, l AS (SELECT class, 'coverage' AS "column", coverage AS v FROM c UNION ALL SELECT class, 'green', green FROM c UNION ALL SELECT class, 'height', height FROM c), w AS (SELECT "column", avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1),
q AS (SELECT class, "column", count(v) AS n, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM l WHERE v IS NOT NULL GROUP BY 1, 2) SELECT class, q."column", n, round(median, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75, round((median - m) / s, 6) AS standardized_median FROM q JOIN w ON w."column" = q."column" """)
def class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.class_profile(cells(spark, sf_dir), METRICS, ["class"]), "median", "q25", "q75", "standardized_median")


_THERMAL = f"""WITH {_CELLS}, {_POOL}, q AS (SELECT class, quantile_cont(heat, 0.25) AS low, quantile_cont(heat, 0.75) AS high FROM c WHERE confidence >= 0.6 GROUP BY 1),
t AS (SELECT p.*, 'cool' AS thermal, low AS threshold FROM p JOIN q ON q.class = p.class WHERE heat <= low UNION ALL SELECT p.*, 'hot', high FROM p JOIN q ON q.class = p.class WHERE heat >= high)"""


def _thermal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.thermal_pools(cells(spark, sf_dir).filter("confidence >= 0.6"), _pool(spark, sf_dir), "class", "heat", "grid_id")


@query(f"""{_THERMAL}, m AS (SELECT class, thermal, quantile_cont(coverage, 0.5) AS mc, quantile_cont(height, 0.5) AS mh, quantile_cont(green, 0.5) AS mg, stddev_pop(coverage) AS sc, stddev_pop(height) AS sh, stddev_pop(green) AS sg FROM t GROUP BY 1, 2),
s AS (SELECT t.class, t.thermal, grid_id, threshold, pow((coverage - mc) / sc, 2) + pow((height - mh) / sh, 2) + pow((green - mg) / sg, 2) AS score FROM t JOIN m ON m.class = t.class AND m.thermal = t.thermal), k AS (SELECT *, row_number() OVER (PARTITION BY class, thermal ORDER BY score, grid_id) AS k FROM s)
SELECT class, thermal, grid_id, round(score, 6) AS score, round(threshold, 4) AS threshold FROM k WHERE k = 1""")
def thermal_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(features.thermal_picks(_thermal(spark, sf_dir), "class", METRICS, "grid_id"), "score"), "threshold", digits=4)


def _steps(*scores: str) -> str:
    """SQL of the prototype steps: each takes the best of what earlier ones left."""
    out = ""
    for i, (name, score) in enumerate(zip(("typical", "coverage", "built", "edge"), scores, strict=True)):
        used = "".join(f" AND NOT EXISTS (SELECT 1 FROM u{j} WHERE u{j}.class = z.class AND u{j}.thermal = z.thermal AND u{j}.grid_id = z.grid_id)" for j in range(i))
        out += f", u{i} AS (SELECT class, thermal, '{name}' AS prototype, grid_id, s AS score FROM (SELECT *, {score} AS s, row_number() OVER (PARTITION BY class, thermal ORDER BY {score} DESC, grid_id) AS k FROM z WHERE true{used}) WHERE k = 1)"
    return out


@query(f"""{_THERMAL}, m AS (SELECT class, thermal, quantile_cont(coverage, 0.5) AS mc, quantile_cont(height, 0.5) AS mh, avg(coverage) AS ac, avg(height) AS ah, stddev_pop(coverage) AS sc, stddev_pop(height) AS sh FROM t GROUP BY 1, 2),
z AS (SELECT t.*, (coverage - ac) / sc AS zc, (height - ah) / sh AS zh, -(pow((coverage - mc) / sc, 2) + pow((height - mh) / sh, 2)) AS typical FROM t JOIN m ON m.class = t.class AND m.thermal = t.thermal){_steps('typical', 'coverage', '(zc + zh) / 2', "CASE WHEN thermal = 'hot' THEN heat ELSE -heat END")}
SELECT class, thermal, prototype, grid_id, round(score, 6) AS score FROM (SELECT * FROM u0 UNION ALL SELECT * FROM u1 UNION ALL SELECT * FROM u2 UNION ALL SELECT * FROM u3)""")
def prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("typical", F.col("typical")), ("coverage", F.col("coverage")), ("built", (F.col("z_coverage") + F.col("z_height")) / 2), ("edge", F.when(F.col("thermal") == "hot", F.col("heat")).otherwise(-F.col("heat")))]
    return rounded(features.prototypes(_thermal(spark, sf_dir), ["class", "thermal"], "grid_id", ["coverage", "height"], steps), "score")


@query(f"""WITH {_CELLS}, {_POOL}, a AS (SELECT 'confident' AS pick, grid_id, district, coverage FROM p WHERE district = '1-URGENT' ORDER BY confidence DESC, coverage DESC, grid_id LIMIT 1), b AS (SELECT 'mixed' AS pick, grid_id, district, coverage FROM p WHERE district = '2-HIGH' AND confidence < 0.9 ORDER BY abs(confidence - 0.5), coverage DESC, grid_id LIMIT 1),
d AS (SELECT 'audited' AS pick, grid_id, district, coverage FROM p WHERE district = '3-MEDIUM' AND grid_id % 7 = 0 ORDER BY coverage DESC, grid_id LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d""")
def example_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = F.col("coverage").desc()
    picks = [
        ("confident", F.col("district") == "1-URGENT", [F.col("confidence").desc(), down, F.col("grid_id")]),
        ("mixed", (F.col("district") == "2-HIGH") & (F.col("confidence") < 0.9), [F.abs(F.col("confidence") - 0.5), down, F.col("grid_id")]),
        ("audited", (F.col("district") == "3-MEDIUM") & (F.col("grid_id") % 7 == 0), [down, F.col("grid_id")]),
    ]
    return features.picked(_pool(spark, sf_dir), picks, ["grid_id", "district", "coverage"])


@query(f"WITH {_CELLS} SELECT grid_id, coverage, row_number() OVER (ORDER BY coverage DESC, grid_id) AS position FROM c QUALIFY position <= 16")
def top_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.first_rows(cells(spark, sf_dir).select("grid_id", "coverage"), [F.col("coverage").desc(), F.col("grid_id")], 16)


_DISTRICT_BINS = "b AS (SELECT grid_id, class, confidence, core, CASE WHEN core = 1 AND green IS NOT NULL THEN row_number() OVER (PARTITION BY core = 1 AND green IS NOT NULL ORDER BY green, grid_id) END AS r, sum(CASE WHEN core = 1 AND green IS NOT NULL THEN 1 ELSE 0 END) OVER () AS n FROM c)"


@query(f"""WITH {_CELLS}, {_DISTRICT_BINS} SELECT grid_id, CASE WHEN r IS NULL THEN 'edge' ELSE ['low', 'medium', 'high'][1 + CAST(3 * (r - 1) >= (n - 1) AND r > 1 AS INTEGER) + CAST(3 * (r - 1) >= 2 * (n - 1) AND r > 1 AS INTEGER)] END AS bin FROM b""")
def green_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.named_terciles(cells(spark, sf_dir), "green", "grid_id", F.col("core") == 1).select("grid_id", "bin")


@query(f"""WITH {_CELLS}, r AS (SELECT class, heat, coverage, row_number() OVER (PARTITION BY class ORDER BY heat, grid_id) AS r, count(*) OVER (PARTITION BY class) AS n, CAST(least(8, greatest(3, count(*) OVER (PARTITION BY class) // 80)) AS INTEGER) AS q FROM c),
b AS (SELECT *, 1 + len(list_filter(range(1, q), lambda x: r > 1 + (n - 1) * (CAST(x AS DOUBLE) / q))) AS bin FROM r WHERE n >= 30)
SELECT class, bin, count(*) AS n, round(quantile_cont(heat, 0.5), 4) AS x_median, round(quantile_cont(coverage, 0.25), 6) AS y_q25, round(quantile_cont(coverage, 0.5), 6) AS y_median, round(quantile_cont(coverage, 0.75), 6) AS y_q75 FROM b GROUP BY 1, 2""")
def heat_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(statistics.trend_bins(cells(spark, sf_dir), "heat", "coverage", "grid_id", ["class"]), "x_median", digits=4), "y_q25", "y_median", "y_q75")


#: Twice the upper tail of Student's t by Simpson's rule over its density, in 4,000 steps.
_TAIL = "1 - 2 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * (z / 12000) * list_sum([(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(z * k / 4000, 2) / (n - 2), -(n - 1) / 2.0) FOR k IN range(4001)])"


@query(f"""WITH {_CELLS}, r AS (SELECT class, rank() OVER (PARTITION BY class ORDER BY heat) + (count(*) OVER (PARTITION BY class, heat) - 1) / 2.0 AS a, rank() OVER (PARTITION BY class ORDER BY coverage) + (count(*) OVER (PARTITION BY class, coverage) - 1) / 2.0 AS b FROM c),
g AS (SELECT class, corr(a, b) AS rho, count(*) AS n FROM r GROUP BY 1), t AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, abs(rho * sqrt((n - 2) / (1 - rho * rho))) AS z FROM g) SELECT class, round(rho, 6) AS rho, n, round(t, 5) AS t, round({_TAIL}, 5) AS p_value FROM t""")
def rank_correlation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(statistics.spearman(cells(spark, sf_dir), "heat", "coverage", ["class"]), "rho"), "t", "p_value", digits=5)


@query(f"""WITH RECURSIVE {_CELLS}, v AS (SELECT heat AS v, sum(CASE WHEN core = 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN core = 1 THEN 0 ELSE 1 END) AS b FROM c GROUP BY 1), d AS (SELECT max(abs(x - y)) AS d, max(na) AS n_a, max(nb) AS n_b FROM (SELECT CAST(sum(a) OVER (ORDER BY v) AS DOUBLE) / sum(a) OVER () AS x, CAST(sum(b) OVER (ORDER BY v) AS DOUBLE) / sum(b) OVER () AS y, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM v)),
p AS (SELECT 0 AS s, [CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0 END FOR i IN range(CAST(n_a AS BIGINT) + 1)] AS q, CAST(round(d * n_a * n_b) AS BIGINT) AS k, CAST(n_a AS BIGINT) AS m, CAST(n_b AS BIGINT) AS n FROM d
  UNION ALL SELECT s + 1, [CASE WHEN s + 1 - i BETWEEN 0 AND n AND abs(i * n - (s + 1 - i) * m) < k THEN (CASE WHEN i > 0 THEN q[i] ELSE 0 END) * i / (s + 1) + q[i + 1] * (s + 1 - i) / (s + 1) ELSE 0 END FOR i IN range(m + 1)], k, m, n FROM p WHERE s < m + n)
SELECT round(d, 6) AS d, m AS n_a, n AS n_b, round(1 - q[m + 1], 5) AS p_value FROM p, d WHERE s = m + n""")
def distribution_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(statistics.ks_two_sample(cells(spark, sf_dir), "heat", F.col("core") == 1), "d"), "p_value", digits=5)


@query(f"WITH {_CELLS}, m AS (SELECT quantile_cont(green, 0.5) AS m FROM c WHERE green > 0) SELECT CASE WHEN green <= 0 THEN 'none' WHEN green <= m THEN 'low' WHEN green IS NOT NULL THEN 'high' END AS tier, count(*) AS n, round(avg(heat), 3) AS heat FROM c, m GROUP BY 1")
def access_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = statistics.access_tiers(cells(spark, sf_dir), "green")
    return rounded(own.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg("heat").alias("heat")), "heat", digits=3)


@query(f"WITH {PREDICTIONS} SELECT model, round(avg(probability) - avg(CASE WHEN true_label = predicted_label THEN 1.0 ELSE 0 END), 6) AS gap FROM q GROUP BY 1")
def confidence_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = predictions(spark, sf_dir)
    return rounded(own.groupBy("model").agg(S.confidence_gap(F.col("probability"), F.col("true_label") == F.col("predicted_label")).alias("gap")), "gap")


@query(f"""WITH {PREDICTIONS}, l AS (SELECT DISTINCT true_label AS label FROM q), t AS (SELECT label, (SELECT count(*) FROM q WHERE true_label = label AND predicted_label <> label) AS outgoing, (SELECT count(*) FROM q WHERE true_label = label AND predicted_label = label) AS kept, (SELECT count(*) FROM q WHERE predicted_label = label AND true_label <> label) AS incoming FROM l)
SELECT label, outgoing, kept, incoming, outgoing + kept + incoming AS total, round((outgoing + kept + incoming) / CAST(sum(outgoing + kept + incoming) OVER () AS DOUBLE), 6) AS share FROM t""")
def chord_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evaluation.confusion(predictions(spark, sf_dir), ["A", "N", "R"], ["model"]).groupBy("true_label", "predicted_label").agg(F.sum("n").alias("n"))
    return rounded(features.chord_totals(counts), "share")


MANIFEST = {"feature_sets": {"built": ["building_quantity", "road_price"], "green": ["canopy_tax", "building_quantity"], "access": ["osm_count"]}, "baseline_recipes": {"all": ["built", "green", "access"], "built": ["built"]}}


@query("SELECT l_suppkey AS grid_id, sum(l_quantity) AS building_quantity, round(avg(l_tax), 9) AS canopy_tax, round(avg(l_discount), 9) AS lst_discount FROM lineitem GROUP BY 1")
def recipe_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.select_recipe(wide(spark, sf_dir), MANIFEST, "all", ["grid_id"], {"osm_count": "lst_discount"}, ("road_price",))
    return rounded(out, "canopy_tax", "lst_discount", digits=9)


@query("""SELECT * FROM (VALUES ('building_quantity', 'building_floor_proxy', 0), ('road_price', 'road_network_exact', 0), ('canopy_tax', 'canopy_height', 0), ('osm_count', 'osm_proxy_context', -1)) v("column", family, s), (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem) WHERE n >= 10""".replace("SELECT *", 'SELECT "column", family, CAST(s AS BIGINT) AS score', 1))
def candidate_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["grid_id", "building_quantity", "road_price", "canopy_tax", "osm_count", "lst_discount"]
    return features.candidate_predictors(profile.column_profile(wide(spark, sf_dir), columns), least_rows=10)


@query("""WITH f(feature, branch, decision) AS (VALUES ('building_quantity', 'core', 'Retain'), ('canopy_tax', 'vegetation', 'Review'), ('coast_min_distance_m', 'coast', 'Retain')), g(feature) AS (VALUES ('building_quantity'), ('osm_count'))
SELECT feature, branch, CASE WHEN feature LIKE 'coast%' THEN 'Missing' ELSE decision END AS decision, feature NOT LIKE 'coast%' AS available, feature IN (SELECT feature FROM g) AS in_group FROM f""")
def feature_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("building_quantity", "core", "Retain"), ("canopy_tax", "vegetation", "Review"), ("coast_min_distance_m", "coast", "Retain")], "feature string, branch string, decision string")
    groups = spark.createDataFrame([("building_quantity; osm_count",)], "features string")
    return features.shortlist(wanted, profile.column_profile(wide(spark, sf_dir), ["building_quantity", "canopy_tax", "osm_count"]), groups)


_IMPORTANCE = """i AS (SELECT l_linestatus AS model, l_linenumber % 5 AS fold, ['building_count', 'road_length', 'canopy_p95', 'dw_trees'][1 + l_partkey % 4] AS feature, sum(l_quantity) AS importance FROM lineitem GROUP BY 1, 2, 3),
w AS (SELECT *, CASE feature WHEN 'building_count' THEN 'building_floor_proxy' WHEN 'road_length' THEN 'road_network_exact' WHEN 'canopy_p95' THEN 'canopy_height' ELSE 'dynamic_world' END AS family FROM i)"""


def _importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(c) for c in ("building_count", "road_length", "canopy_p95", "dw_trees")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    own = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("model"), (F.col("l_linenumber") % 5).alias("fold"), names.alias("feature"), "l_quantity")
    return own.groupBy("model", "fold", "feature").agg(F.sum("l_quantity").alias("importance"))


@query(f"WITH {_IMPORTANCE} SELECT model, feature, family, round(avg(importance), 4) AS importance_mean, round(stddev_samp(importance), 4) AS importance_sd FROM w GROUP BY 1, 2, 3")
def importance_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.importance_by_feature(_importances(spark, sf_dir), ["model"]), "importance_mean", "importance_sd", digits=4)


@query(f"WITH {_IMPORTANCE}, s AS (SELECT model, fold, family, sum(importance) AS s FROM w GROUP BY 1, 2, 3) SELECT model, family, round(avg(s), 4) AS importance_mean, round(stddev_samp(s), 4) AS importance_sd FROM s GROUP BY 1, 2")
def importance_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.importance_by_family(_importances(spark, sf_dir), ["model"]), "importance_mean", "importance_sd", digits=4)


@query(f"WITH {_IMPORTANCE} SELECT model, fold, feature, round(importance / sum(importance) OVER (PARTITION BY model, fold), 6) AS share FROM i")
def importance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(zonal.shares_within(_importances(spark, sf_dir), ["model", "fold"], "importance").select("model", "fold", "feature", "share"), "share")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END AS prob_3, CASE WHEN p_size % 2 = 0 THEN 0.75::DOUBLE ELSE 0.4::DOUBLE END AS prob_6, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 0.6::DOUBLE END AS prob_8, CASE WHEN p_size % 2 = 0 THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END AS predicted_probability FROM part""")
def aligned_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    own = table(spark, sf_dir, "part").select("p_partkey", F.when(even, F.array(F.lit(3), F.lit(6))).otherwise(F.array(F.lit(8), F.lit(6))).alias("c"), F.when(even, F.array(F.lit(0.25), F.lit(0.75))).otherwise(F.array(F.lit(0.6), F.lit(0.4))).alias("p"))
    return features.aligned_probabilities(own, "c", "p", [3, 6, 8]).drop("c", "p")


_TWO = """k AS (SELECT o_orderkey AS grid_id, o_orderstatus AS true_label, CASE WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS primary_label, 0.5 + (o_orderkey % 50) / 100.0::DOUBLE AS p FROM orders), o AS (SELECT o_orderkey AS grid_id, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS comparison_label FROM orders WHERE o_orderkey % 11 <> 0),
j AS (SELECT k.*, comparison_label, true_label = primary_label AS correct, NOT coalesce(primary_label = comparison_label, false) AS disagree, 1 - p AS warning_score FROM k LEFT JOIN o ON o.grid_id = k.grid_id)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    p = F.lit(0.5) + k % 50 / 100.0
    orders = table(spark, sf_dir, "orders")
    first = orders.select(k.alias("grid_id"), F.col("o_orderstatus").alias("true_label"), F.when(k % 5 == 0, "P").otherwise(F.col("o_orderstatus")).alias("predicted_label"), p.alias("probability"), p.alias("pa"), ((1 - p) * 0.75).alias("pb"), ((1 - p) * 0.25).alias("pc"))
    second = orders.filter(k % 11 != 0).select(k.alias("grid_id"), F.when(k % 7 == 0, "F").otherwise(F.col("o_orderstatus")).alias("predicted_label"))
    return features.two_models(first, second, "grid_id", ["pa", "pb", "pc"])


@query(f"WITH {_TWO}, e AS (SELECT *, -(p * ln(p) + greatest((1 - p) * 0.75, 1e-12) * ln(greatest((1 - p) * 0.75, 1e-12)) + greatest((1 - p) * 0.25, 1e-12) * ln(greatest((1 - p) * 0.25, 1e-12))) / ln(3) AS entropy FROM j) SELECT grid_id, true_label, primary_label, round(p, 6) AS primary_probability, round(entropy, 6) AS entropy, comparison_label, correct, disagree, round(warning_score, 6) AS warning_score FROM e")
def uncertainty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_two(spark, sf_dir), "primary_probability", "entropy", "warning_score")


@query(f"""WITH {_TWO}, l(label) AS (VALUES ('F'), ('O'), ('P'), ('X')), g AS (SELECT true_label AS label, count(*) AS n, 100 * (1 - avg(CASE WHEN primary_label = true_label THEN 1.0 ELSE 0 END)) AS a, 100 * (1 - avg(CASE WHEN comparison_label = true_label THEN 1.0 ELSE 0 END)) AS b FROM j GROUP BY 1)
SELECT l.label AS true_label, coalesce(n, 0) AS n, round(a, 6) AS first_contradiction, round(b, 6) AS second_contradiction FROM l LEFT JOIN g ON g.label = l.label""")
def class_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _two(spark, sf_dir).withColumn("truth", F.col("true_label"))
    out = features.contradictions(own, "true_label", "truth", {"first": "primary_label", "second": "comparison_label"}, ["F", "O", "P", "X"])
    return rounded(out, "first_contradiction", "second_contradiction")


_RANGES = """m AS (SELECT o_orderpriority AS district, avg(o_totalprice) / 1e6 AS accuracy, avg(o_custkey) / 1e6 AS balanced, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS macro FROM orders GROUP BY 1), f AS (SELECT o_orderpriority AS district, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END) AS macro FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)"""


@query(f"WITH {_RANGES} SELECT m.district, round(accuracy, 6) AS accuracy, round(balanced, 6) AS balanced, round(m.macro, 6) AS macro, round(least(accuracy, balanced, m.macro), 6) AS low, round(greatest(accuracy, balanced, m.macro), 6) AS high, round(f.macro, 6) AS other_macro, round(m.macro - f.macro, 6) AS lead FROM m LEFT JOIN f ON f.district = m.district")
def district_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "district")
    share = lambda x: F.avg((F.col("o_orderstatus") == x).cast("double")).alias("macro")
    first = orders.groupBy("district").agg((F.avg("o_totalprice") / 1e6).alias("accuracy"), (F.avg("o_custkey") / 1e6).alias("balanced"), share("F"))
    other = orders.filter("district <> '5-LOW'").groupBy("district").agg(share("O"))
    return rounded(features.metric_ranges(first, "district", ["accuracy", "balanced", "macro"], other, "macro"), "accuracy", "balanced", "macro", "low", "high", "other_macro", "lead")


@query("SELECT 'canopy' AS name, round(greatest(0, quantile_cont(value, 0.02)), 6) AS p02, round(greatest(5, quantile_cont(value, 0.98)), 6) AS p98 FROM events WHERE value IS NOT NULL AND isfinite(value)")
def stretch_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.stretch_limits(table(spark, sf_dir, "events"), "value", "canopy", 0.0, 5.0), "p02", "p98")


@query("""WITH s AS (SELECT ['a', 'b', 'c', 'd'][1 + l_linenumber % 4] AS recipe, count(*) AS features, round(avg(l_discount), 6) AS f1 FROM lineitem GROUP BY 1), o AS (SELECT *, CASE recipe WHEN 'b' THEN 0 WHEN 'a' THEN 1 ELSE 2 END AS position FROM s WHERE recipe <> 'd') SELECT recipe, position, features, f1, CASE WHEN row_number() OVER (ORDER BY f1 DESC, position) = 1 THEN 1 ELSE 0 END AS best FROM o""")
def recipe_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(c) for c in "abcd"]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    summary = table(spark, sf_dir, "lineitem").groupBy(names.alias("recipe")).agg(F.count(F.lit(1)).alias("features"), F.round(F.avg("l_discount"), 6).alias("f1"))
    return features.recipe_curve(summary, "recipe", "f1", "features", ["b", "a", "c"])


@query("SELECT p_partkey, greatest(coalesce(CASE WHEN p_partkey % 9 <> 0 THEN p_size - 3 END, 1), 1) * 3.2::DOUBLE AS height FROM part")
def building_massing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") - 3).alias("floors"))
    return features.massing(own, "floors").select("p_partkey", "height")


@query("""WITH m AS (SELECT l_linenumber AS cost, l_quantity / 10 AS access FROM lineitem) SELECT cost, count(*) AS n, round(avg(ln(1 + access)), 6) AS mean_log1p, round(avg(CASE WHEN access > 2 THEN 1.0 ELSE 0 END), 6) AS above FROM m GROUP BY 1""")
def access_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("cost"), (F.col("l_quantity") / 10).alias("access"))
    return rounded(own.groupBy("cost").agg(F.count(F.lit(1)).alias("n"), F.avg(F.log1p("access")).alias("mean_log1p"), F.avg((F.col("access") > 2).cast("double")).alias("above")), "mean_log1p", "above")


@query("SELECT p_partkey, 'x' || CAST(p_partkey AS VARCHAR) AS label, '' AS note, '' AS reviewer FROM part")
def audit_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("label"), "p_size")
    return features.sheet_template(own, ["p_partkey", "label", "not_there"], ["note", "reviewer"])


_NAMES = ["Straße Žižkov ő", "İzmir Çiğli", "ılık SU", "naïve x² ﬁn", " A--b  c "]
_PLAIN = ["stra e zizkov o", "izmir cigli", "ilik su", "naive x2 fin", "a b c"]


@query(f"SELECT p_partkey, {_PLAIN!r}[1 + p_partkey % 5] || ' ' || CAST(p_partkey AS VARCHAR) AS name, ['building', 'cigli', 'ada', 'kent', 'park'][1 + p_partkey % 5] AS core FROM part")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (k % 5 + 1).cast("int")), k.cast("string"))
    words = F.element_at(F.array(*[F.lit(x) for x in ("building", "cigli mahallesi", "yesil ada", "kent parki", "park")]), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.normalise_text(name).alias("name"), S.drop_stop_words(words).alias("core"))


_SHEET = """s AS (SELECT doc_id AS grid_id, source AS district, n_chars AS area, CAST(doc_id % 4 + 1 AS VARCHAR) AS weak FROM documents),
a AS (SELECT grid_id, CASE WHEN grid_id % 23 = 0 THEN 'elsewhere' ELSE district END AS district, CAST(CASE WHEN grid_id % 17 = 0 THEN area + 1 ELSE area END AS VARCHAR) AS area, weak, CASE grid_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'one' WHEN 2 THEN ' two' WHEN 3 THEN 'mixed' WHEN 4 THEN 'edge_insufficient' ELSE 'bogus' END AS audit_label,
  CASE grid_id % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'reject_edge' WHEN 3 THEN 'odd' WHEN 4 THEN '' ELSE 'high' END AS label_quality, CASE WHEN grid_id % 5 <> 0 THEN 'n' END AS dominant_fabric_note, 'l' AS audit_source_layers, CASE WHEN grid_id % 11 = 0 THEN ' ' ELSE 'me' END AS audit_reviewer, ['2026-6-1', '2026-06-01', '1.6.2026', ''][1 + grid_id % 4] AS audit_date FROM s WHERE grid_id % 29 <> 0
  UNION ALL SELECT -5, 'x', '1', '1', 'one', 'high', 'n', 'l', 'me', '2026-06-01')"""
_GATE = f"""{_SHEET}, b AS (SELECT *, trim(audit_label) AS l, trim(label_quality) AS q FROM a), i AS (
  SELECT CAST(grid_id AS VARCHAR) AS grid_id, 'grid_id' AS field, 'error' AS severity, 'grid_id_not_in_source_gpkg' AS issue, CAST(grid_id AS VARCHAR) AS value FROM a WHERE grid_id NOT IN (SELECT grid_id FROM s)
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'grid_id', 'error', 'source_grid_id_missing_from_csv', CAST(grid_id AS VARCHAR) FROM s WHERE grid_id NOT IN (SELECT grid_id FROM a)
  UNION ALL SELECT '', 'shape', 'warning', 'fixed_field_not_available_in_source_gpkg', ''
  UNION ALL SELECT CAST(a.grid_id AS VARCHAR), 'district', 'error', 'fixed_source_field_changed', a.district FROM a JOIN s ON s.grid_id = a.grid_id WHERE coalesce(a.district, '') <> coalesce(s.district, '')
  UNION ALL SELECT CAST(a.grid_id AS VARCHAR), 'area', 'error', 'fixed_source_field_changed', a.area FROM a JOIN s ON s.grid_id = a.grid_id WHERE TRY_CAST(a.area AS DOUBLE) <> s.area
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'audit_label', 'error', 'partial_row_without_audit_label', '' FROM b WHERE l = ''
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'audit_label', 'error', 'invalid_audit_label', l FROM b WHERE l = 'bogus'
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'label_quality', 'error', 'invalid_or_missing_label_quality', q FROM b WHERE l <> '' AND q NOT IN ('high', 'low', 'reject_edge')
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'dominant_fabric_note', 'error', 'required_audit_field_missing', '' FROM b WHERE l <> '' AND dominant_fabric_note IS NULL
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'audit_reviewer', 'error', 'required_audit_field_missing', '' FROM b WHERE l <> '' AND trim(audit_reviewer) = ''
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'audit_date', 'error', 'required_audit_field_missing', '' FROM b WHERE l <> '' AND audit_date = ''
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'audit_date', 'error', 'date_not_iso_yyyy_mm_dd', audit_date FROM b WHERE l <> '' AND audit_date = '1.6.2026'
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'label_quality', 'error', 'edge_insufficient_requires_reject_edge', q FROM b WHERE l = 'edge_insufficient' AND q <> 'reject_edge'
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'audit_label', 'warning', 'reject_edge_quality_with_non_edge_label', l FROM b WHERE l NOT IN ('', 'edge_insufficient') AND q = 'reject_edge'
  UNION ALL SELECT CAST(grid_id AS VARCHAR), 'label_quality', 'warning', 'ambiguous_label_marked_high_quality', q FROM b WHERE l = 'mixed' AND q = 'high')"""
_FIELDS = ["audit_label", "label_quality", "dominant_fabric_note", "audit_source_layers", "audit_reviewer", "audit_date"]
_CODES = ["one", "two", "mixed", "edge_insufficient"]


def _gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("grid_id")
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("grid_id"), F.col("source").alias("district"), F.col("n_chars").alias("area"), (F.col("doc_id") % 4 + 1).cast("string").alias("weak"))

    def nth(n: int, *values: str):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))

    sheet = source.filter(k % 29 != 0).select(
        "grid_id", F.when(k % 23 == 0, "elsewhere").otherwise(F.col("district")).alias("district"), F.when(k % 17 == 0, F.col("area") + 1).otherwise(F.col("area")).cast("string").alias("area"), "weak",
        nth(6, "", "one", " two", "mixed", "edge_insufficient", "bogus").alias("audit_label"), nth(7, "high", "low", "reject_edge", "odd", "", "high", "high").alias("label_quality"), F.when(k % 5 != 0, "n").alias("dominant_fabric_note"),
        F.lit("l").alias("audit_source_layers"), F.when(k % 11 == 0, " ").otherwise("me").alias("audit_reviewer"), nth(4, "2026-6-1", "2026-06-01", "1.6.2026", "").alias("audit_date"), F.lit("s").alias("shape"),
    )
    more = spark.createDataFrame([(-5, "x", "1", "1", "one", "high", "n", "l", "me", "2026-06-01", "s")], sheet.schema)
    codebook = spark.createDataFrame([(c,) for c in _CODES], "audit_label string")
    return sheet.unionByName(more), source, codebook


def _gate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet, source, codebook = _gate(spark, sf_dir)
    return audit.gate_issues(sheet, source, "grid_id", codebook, ["district", "shape"], ["area"], _FIELDS)


@query(f"WITH {_GATE} SELECT * FROM i")
def gate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate_issues(spark, sf_dir)


@query(f"""WITH {_GATE}, v AS (SELECT *, l IN ('one', 'two', 'mixed', 'edge_insufficient') AND q IN ('high', 'low', 'reject_edge') AS ok FROM b)
SELECT (SELECT count(*) FROM a) AS rows, count(*) FILTER (l <> '') AS completed_rows, count(*) FILTER (ok) AS valid_completed_rows, count(*) FILTER (q = 'high') AS high_rows, count(*) FILTER (q = 'medium') AS medium_rows, count(*) FILTER (q = 'low') AS low_rows, count(*) FILTER (q = 'reject_edge') AS reject_edge_rows,
  round(avg(CASE WHEN ok THEN CASE WHEN (weak = '1' AND l = 'one') OR (weak = '2' AND l = 'two') THEN 1.0 ELSE 0 END END), 6) AS exact_agreement, (SELECT count(*) FROM i WHERE severity = 'error') AS errors, (SELECT count(*) FROM i WHERE severity = 'warning') AS warnings, 'partial_with_errors' AS status, false AS ready, round(count(*) FILTER (l <> '') / CAST(count(*) AS DOUBLE), 6) AS completion_share FROM v""")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet, _, codebook = _gate(spark, sf_dir)
    return rounded(audit.gate_summary(sheet, _gate_issues(spark, sf_dir), codebook, "weak", {1: "one", 2: "two"}), "exact_agreement", "completion_share")


@query(f"WITH {_CELLS} SELECT district, round(avg(confidence), 6) AS confidence, count(*) AS n FROM c WHERE class IN ('F', 'O') AND confidence >= 0.6 GROUP BY 1")
def class_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = panels.modelling_population(cells(spark, sf_dir), "class", "confidence", ["F", "O"], 0.6, 1)
    return rounded(own.groupBy("district").agg(F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n")), "confidence")
