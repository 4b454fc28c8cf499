"""Queries over tables: merges, profiles, statistics, selections, evaluation, audits and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import scalar as S
from latticework.operators import audit, evaluation, matching, merge, profile, selection, statistics

from .inputs import LABELS, PREDICTIONS, WIDE, predictions, rounded, table, wide

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("grid_id"), F.col("c_mktsegment").alias("segment"), F.lit("base").alias("state"))
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grid_id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("state"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("line"))
    return base, merge.last_of_key(right, "grid_id", "line")


_RIGHT = "r AS (SELECT grid_id, state, priority FROM (SELECT o_custkey AS grid_id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS state, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1)"


@query(f"WITH {_RIGHT} SELECT * FROM r")
def last_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir)[1]


@query(f"WITH {_RIGHT} SELECT c.c_custkey AS grid_id, c.c_mktsegment AS segment, CASE WHEN r.grid_id IS NOT NULL THEN r.state ELSE 'base' END AS state, r.priority FROM customer c LEFT JOIN r ON r.grid_id = c.c_custkey")
def override_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.override_merge(*_base(spark, sf_dir), "grid_id")


@query("""SELECT 'orders' AS input, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS extra""")
def join_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, right = _base(spark, sf_dir)
    return merge.join_loss(base, {"orders": right}, "grid_id")


@query("""WITH d AS (SELECT p_partkey AS grid_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size % 7 AS VARCHAR) END AS road_length, CAST(p_size % 4 AS VARCHAR) AS nodes, CAST(p_size % 3 AS VARCHAR) AS intersections,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size / 60.0 AS DOUBLE) END AS dead_end_share, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size / 25.0 AS DOUBLE) END AS open_share, CASE WHEN p_partkey % 4 = 0 THEN 0.5::DOUBLE END AS continuity FROM part),
n AS (SELECT *, coalesce(TRY_CAST(road_length AS DOUBLE), 0) AS r, CAST(nodes AS DOUBLE) AS n, CAST(intersections AS DOUBLE) AS i, CASE WHEN dead_end_share IS NULL THEN 0 ELSE least(greatest(1 - dead_end_share, 0), 1) END AS pen FROM d),
p AS (SELECT *, CASE WHEN n > 0 THEN least(greatest((least(greatest(i / n, 0), 1) + pen) / 2, 0), 1) ELSE 0.0 END AS net FROM n)
SELECT grid_id, CASE WHEN r > 0 THEN 1 ELSE 0 END AS road_flag, CASE WHEN continuity IS NOT NULL THEN 1 ELSE 0 END AS continuity_flag, round(net, 6) AS network_proxy, round(CASE WHEN open_share IS NOT NULL THEN least(greatest(open_share, 0), 1) * net WHEN r <= 0 THEN 0.0 END, 6) AS street_proxy FROM p""")
def permeability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    d = table(spark, sf_dir, "part").select(k.alias("grid_id"), F.when(k % 5 == 0, "").otherwise((s % 7).cast("string")).alias("road_length"), (s % 4).cast("string").alias("nodes"), (s % 3).cast("string").alias("intersections"), F.when(k % 3 != 0, s / 60.0).alias("dead_end_share"), F.when(k % 2 == 0, s / 25.0).alias("open_share"), F.when(k % 4 == 0, F.lit(0.5)).alias("continuity"))
    return rounded(merge.permeability(d).select("grid_id", "road_flag", "continuity_flag", "network_proxy", "street_proxy"), "network_proxy", "street_proxy")


COLUMNS = ["osm_count", "building_quantity", "road_price", "lst_discount", "canopy_tax", "morph_lines", "dw_gap"]
_FAMILY = "CASE WHEN c LIKE 'lst\\_%' ESCAPE '\\' THEN 'climate_response' WHEN c LIKE 'dw\\_%' ESCAPE '\\' THEN 'dynamic_world' WHEN c LIKE 'canopy\\_%' ESCAPE '\\' THEN 'canopy_height' WHEN c LIKE 'osm\\_%' ESCAPE '\\' THEN 'osm_proxy_context' WHEN c LIKE 'morph\\_%' ESCAPE '\\' THEN 'building_footprint_morphometrics' WHEN c LIKE 'road\\_%' ESCAPE '\\' THEN 'road_network_exact' WHEN c LIKE 'building\\_%' ESCAPE '\\' THEN 'building_floor_proxy' ELSE 'other' END"
_LONG = f"{WIDE}, l AS ({' UNION ALL '.join(f'''SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS v FROM w''' for c in COLUMNS)})"


@query(f"""WITH {_LONG}, t AS (SELECT c, max(n) AS top FROM (SELECT c, v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT l.c AS "column", {_FAMILY.replace('c LIKE', 'l.c LIKE')} AS family, CASE WHEN l.c LIKE 'lst%' THEN 'climate_outcome' ELSE 'candidate_predictor' END AS role, count(*) AS rows, count(v) AS non_null, count(*) - count(v) AS missing, count(DISTINCT v) AS unique_count, round(max(top) / CAST(count(v) AS DOUBLE), 6) AS top_share,
  round(sum(CASE WHEN v = 0 THEN 1 ELSE 0 END) / CAST(count(v) AS DOUBLE), 6) AS zero_share, round(min(v), 4) AS min, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.5), 4) AS median, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.95), 4) AS p95, round(max(v), 4) AS max,
  CASE WHEN count(DISTINCT v) <= 1 THEN 1 ELSE 0 END AS constant_flag, CASE WHEN count(DISTINCT v) <= 1 OR max(top) / CAST(count(v) AS DOUBLE) >= 0.99 THEN 1 ELSE 0 END AS near_constant_flag FROM l JOIN t ON t.c = l.c GROUP BY 1, 2, 3""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(profile.column_profile(wide(spark, sf_dir), COLUMNS), "top_share", "zero_share"), "min", "p05", "median", "mean", "p95", "max", digits=4)


@query("""WITH l AS (SELECT 'c_mktsegment' AS c, c_mktsegment AS v FROM customer UNION ALL SELECT 'c_nationkey', CAST(CASE WHEN c_nationkey % 6 <> 0 THEN c_nationkey END AS VARCHAR) FROM customer), n AS (SELECT c, v, count(*) AS n FROM l GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v NULLS LAST) AS k FROM n)
SELECT c AS "column", v AS value, n, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 10""")
def value_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_mktsegment", F.when(F.col("c_nationkey") % 6 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    return profile.value_counts(own, ["c_mktsegment", "c_nationkey"], 10)


@query(f"""WITH {_LONG}, m AS (SELECT c, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0 END) AS missing FROM l GROUP BY 1) SELECT {_FAMILY} AS family, count(*) AS columns, round(avg(missing), 6) AS mean_missing, round(max(missing), 6) AS max_missing FROM m GROUP BY 1""")
def family_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.family_missingness(profile.column_profile(wide(spark, sf_dir), COLUMNS)), "mean_missing", "max_missing")


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM w" for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :])


@query(f"WITH {WIDE}, p AS ({_PAIRS}) SELECT a, b, round(r, 6) AS r, n FROM p WHERE n >= 20 AND r IS NOT NULL AND NOT isnan(r)")
def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.correlation_pairs(wide(spark, sf_dir), COLUMNS, 20), "r")


@query(f"""WITH RECURSIVE {WIDE}, p AS ({_PAIRS}), e AS (SELECT a, b FROM p WHERE n >= 20 AND NOT isnan(r) AND abs(r) >= 0.9 UNION SELECT b, a FROM p WHERE n >= 20 AND NOT isnan(r) AND abs(r) >= 0.9), r AS (SELECT a AS s, a AS t FROM e UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.t), g AS (SELECT s, min(t) AS grp FROM r GROUP BY 1)
SELECT grp AS "group", count(*) AS feature_count, string_agg(s, '; ' ORDER BY s) AS features FROM g GROUP BY 1""")
def collinearity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.collinear_groups(profile.correlation_pairs(wide(spark, sf_dir), COLUMNS, 20), 0.9)


@query(f"""WITH f AS (SELECT c, {_FAMILY} AS family FROM (VALUES {', '.join(f"('{c}')" for c in COLUMNS)}) v(c))
SELECT c AS "column", family, CASE WHEN c LIKE 'lst%' THEN 'climate_outcome' ELSE 'candidate_predictor' END AS role, CASE WHEN c LIKE 'lst%' THEN 'outcome' WHEN family = 'dynamic_world' THEN 'overlaps label source' ELSE 'proxy context' END AS issue FROM f WHERE family IN ('climate_response', 'dynamic_world', 'osm_proxy_context')""")
def leakage_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.leakage_screen(profile.column_profile(wide(spark, sf_dir), COLUMNS))


@query("""WITH r AS (SELECT p_partkey, p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS k, count(*) OVER () AS n FROM part) SELECT p_partkey, CAST(1 + CASE WHEN 3 * (k - 1) >= (n - 1) AND k > 1 THEN 1 ELSE 0 END + CASE WHEN 3 * (k - 1) >= 2 * (n - 1) AND k > 1 THEN 1 ELSE 0 END AS BIGINT) AS bin FROM r""")
def built_intensity_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.rank_bins(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 3).select("p_partkey", "bin")


@query("""WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS x, l_quantity AS y, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
b AS (SELECT *, 1 + CAST(k > 1 + (n - 1) * (25.0::DOUBLE / 100) AS INTEGER) + CAST(k > 1 + (n - 1) * (50.0::DOUBLE / 100) AS INTEGER) + CAST(k > 1 + (n - 1) * (75.0::DOUBLE / 100) AS INTEGER) AS bin FROM r)
SELECT g, CAST(bin AS BIGINT) AS bin, count(*) AS n, round(quantile_cont(y, 0.25), 6) AS q25, round(quantile_cont(y, 0.5), 6) AS q50, round(quantile_cont(y, 0.75), 6) AS q75 FROM b GROUP BY 1, 2""")
def binned_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return rounded(statistics.log_bin_profile(statistics.rank_bins(li, "x", "o", 4, ["g"]), "y", ["g", "bin"]), "q25", "q50", "q75")


@query("""WITH r AS (SELECT o_orderpriority AS g, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS a, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS b FROM orders) SELECT g, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.spearman(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "g"), "o_totalprice", "o_custkey", ["g"])
    return rounded(out.select("g", "rho", "n"), "rho")


@query("""WITH r AS (SELECT l_returnflag AS g, CAST(rank() OVER (ORDER BY l_quantity) AS DOUBLE) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY l_quantity) AS t, CAST(count(*) OVER () AS DOUBLE) AS n FROM lineitem), s AS (SELECT g, sum(r) AS r, count(*) AS c, max(n) AS n FROM r GROUP BY 1), t AS (SELECT sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r),
h AS (SELECT (12 / (max(n) * (max(n) + 1)) * sum(r * r / c) - 3 * (max(n) + 1)) / (1 - max(ties) / (max(n) * max(n) * max(n) - max(n))) AS h, count(*) AS k, max(n) AS n FROM s, t) SELECT round(h, 4) AS h, k AS groups, round(greatest((h - k + 1) / (n - k), 0), 6) AS epsilon2, round(exp(-h / 2), 8) AS p_value FROM h""")
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(statistics.kruskal_wallis(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag"), "h", digits=4), "epsilon2").withColumn("p_value", F.round("p_value", 8))


@query("""WITH c AS (SELECT l_quantity AS v, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_linestatus <> 'O' THEN 1 ELSE 0 END) AS b FROM lineitem GROUP BY 1), g AS (SELECT abs(CAST(sum(a) OVER (ORDER BY v) AS DOUBLE) / sum(a) OVER () - CAST(sum(b) OVER (ORDER BY v) AS DOUBLE) / sum(b) OVER ()) AS d FROM c) SELECT round(max(d), 6) AS d FROM g""")
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.ks_two_sample(table(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_linestatus") == "O").select("d"), "d")


@query("""WITH d AS (SELECT o_orderpriority AS g, ln(1 + o_totalprice) AS x, ln(1 + o_custkey) AS y FROM orders), p AS (SELECT DISTINCT g FROM d), l AS (SELECT p.g, corr(d.x, d.y) AS r FROM p JOIN d ON d.g <> p.g GROUP BY 1) SELECT round((SELECT corr(x, y) FROM d), 6) AS r_all, round(min(r), 6) AS r_min, round(max(r), 6) AS r_max FROM l""")
def log_corr_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.log_correlation_left_out(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", "o_orderpriority"), "r_all", "r_min", "r_max")


@query("SELECT l_returnflag AS g, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1")
def ols_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.ols_line(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g"), "l_quantity", "l_extendedprice", ["g"])
    return rounded(rounded(rounded(out, "slope", digits=4), "intercept", digits=3), "r2")


@query("""WITH q AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS b, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1) SELECT g, round(a, 4) AS q25, round(m, 4) AS median, round(b, 4) AS q75, round(greatest(lo, a - (b - a) * 1.5), 4) AS low_whisker, round(least(hi, b + (b - a) * 1.5), 4) AS high_whisker FROM q""")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.box_stats(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g"), "l_extendedprice", ["g"]), "q25", "median", "q75", "low_whisker", "high_whisker", digits=4)


@query("SELECT DISTINCT l_returnflag AS g, l_quantity AS v, round(cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity), 6) AS ecdf FROM lineitem")
def ecdf_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.ecdf(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("v")), "v", ["g"]), "ecdf")


@query("""SELECT l_returnflag AS g, round(a.range / 10.0, 4) AS at, round(sum(exp(-((a.range / 10.0 - l_discount * 10) / 0.35) * ((a.range / 10.0 - l_discount * 10) / 0.35) / 2)) / (count(*) * 0.35 * sqrt(2 * pi())), 6) AS density FROM lineitem, range(0, 11) a GROUP BY 1, 2""")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_discount") * 10).alias("v"))
    return rounded(rounded(statistics.kernel_density(own, "v", ["g"], 0.0, 1.0, 11, 0.35), "at", digits=4), "density")


_ITEM = "i AS (SELECT l_returnflag AS g, l_orderkey * 10 + l_linenumber AS id, l_quantity, l_extendedprice, l_discount FROM lineitem)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_extendedprice", "l_discount")


@query(f"""WITH {_ITEM}, m AS (SELECT g, quantile_cont(l_quantity, 0.5) AS a, quantile_cont(l_extendedprice, 0.5) AS b, stddev_pop(l_quantity) AS sa, stddev_pop(l_extendedprice) AS sb FROM i GROUP BY 1), s AS (SELECT i.g, id, pow((l_quantity - a) / sa, 2) + pow((l_extendedprice - b) / sb, 2) AS score FROM i JOIN m ON m.g = i.g), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score, id) AS k FROM s)
SELECT g, id, round(score, 6) AS score FROM k WHERE k = 1""")
def medoid_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.medoids(_items(spark, sf_dir), "g", ["l_quantity", "l_extendedprice"], "id"), "score")


@query(f"""WITH {_ITEM}, q AS (SELECT g, quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM i GROUP BY 1) SELECT i.g, CASE WHEN l_quantity <= a THEN 'cool' WHEN l_quantity >= b THEN 'hot' ELSE 'between' END AS gate, count(*) AS n FROM i JOIN q ON q.g = i.g GROUP BY 1, 2""")
def quartile_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.quartile_gate(_items(spark, sf_dir), "l_quantity", "g").groupBy("g", "gate").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT doc_id, 'longest' AS category, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents), a1 AS (SELECT * FROM a WHERE position <= 12), b AS (SELECT doc_id, 'shortest' AS category, row_number() OVER (ORDER BY n_chars, doc_id) AS position FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a1)), b1 AS (SELECT * FROM b WHERE position <= 12),
c AS (SELECT doc_id, 'english' AS category, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM a1 UNION SELECT doc_id FROM b1)) SELECT * FROM a1 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM c WHERE position <= 12""")
def category_topk_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rules = [("longest", lambda d: d, [n.desc()], 12), ("shortest", lambda d: d, [n.asc()], 12), ("english", lambda d: d.filter("lang = 'en'"), [n.desc()], 12)]
    return selection.exclusive_top(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id", rules)


@query("""WITH s AS (SELECT c_custkey, c_mktsegment || '|' || CAST(c_nationkey % 3 AS VARCHAR) AS stratum, md5(CAST(c_custkey AS VARCHAR)) AS h FROM customer), z AS (SELECT stratum, count(*) AS size FROM s GROUP BY 1), w AS (SELECT *, least(size, greatest(8, CAST(round_even(200.0::DOUBLE * size / sum(size) OVER (), 0) AS BIGINT))) AS wanted FROM z), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, c_custkey) AS position FROM s)
SELECT k.stratum, c_custkey, CASE WHEN size <= 8 THEN 'certainty_rare' ELSE 'random_audit' END AS role, position FROM k JOIN w ON w.stratum = k.stratum WHERE position <= wanted""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_nationkey") % 3).alias("third"))
    return selection.stratified_sample(own, ["c_mktsegment", "third"], "c_custkey", 200, 8)


_CONF = f"WITH {PREDICTIONS}, lab AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) v(x)), k AS (SELECT DISTINCT model, recipe, fold FROM q), c AS (SELECT k.model, k.recipe, k.fold, a.x AS true_label, b.x AS predicted_label, count(q.model) AS n FROM k CROSS JOIN lab a CROSS JOIN lab b LEFT JOIN q ON q.model = k.model AND q.recipe = k.recipe AND q.fold = k.fold AND q.true_label = a.x AND q.predicted_label = b.x GROUP BY ALL)"
_KEYS = ["model", "recipe", "fold"]
_PRF = f"{_CONF}, t AS (SELECT model, recipe, fold, x AS label, CAST(sum(CASE WHEN true_label = x THEN n ELSE 0 END) AS BIGINT) AS support, CAST(sum(CASE WHEN predicted_label = x THEN n ELSE 0 END) AS BIGINT) AS named, CAST(sum(CASE WHEN predicted_label = x AND true_label = x THEN n ELSE 0 END) AS DOUBLE) AS tp FROM c, lab GROUP BY ALL), s AS (SELECT *, CASE WHEN named > 0 THEN tp / named ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN named + support > 0 THEN 2 * tp / (named + support) ELSE 0 END AS f1 FROM t)"
_FOLD = f"{_PRF}, m AS (SELECT model, recipe, fold, CAST(sum(support) AS BIGINT) AS rows, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM s GROUP BY ALL)"


@query(f"{_CONF} SELECT * FROM c")
def confusion_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(predictions(spark, sf_dir), LABELS, _KEYS)


@query(f"{_PRF} SELECT model, recipe, fold, label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s")
def class_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.class_scores(predictions(spark, sf_dir), LABELS, _KEYS), "precision", "recall", "f1")


@query(f"{_FOLD} SELECT model, recipe, fold, rows, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM m")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.fold_metrics(predictions(spark, sf_dir), LABELS, _KEYS), "accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")


@query(f"{_FOLD} SELECT model, recipe, count(*) AS folds, round(avg(macro_f1), 6) AS mean, round(stddev_samp(macro_f1), 6) AS sd, round(min(macro_f1), 6) AS min, round(max(macro_f1), 6) AS max FROM m GROUP BY 1, 2")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.fold_metrics(predictions(spark, sf_dir), LABELS, _KEYS)
    return rounded(evaluation.metric_summary(m, ["model", "recipe"], "macro_f1"), "mean", "sd", "min", "max")


@query(f"{_FOLD} SELECT a.model, a.fold, a.recipe, round(a.macro_f1 - b.macro_f1, 6) AS delta FROM m a JOIN m b ON a.model = b.model AND a.fold = b.fold AND b.recipe = 'r0' WHERE a.recipe <> 'r0'")
def fold_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.fold_metrics(predictions(spark, sf_dir), LABELS, _KEYS)
    return rounded(evaluation.fold_deltas(m, "recipe", "r0", ["model", "fold"], "macro_f1"), "delta")


@query(f"{_FOLD}, d AS (SELECT a.model, a.recipe, a.macro_f1 - b.macro_f1 AS delta FROM m a JOIN m b ON a.model = b.model AND a.fold = b.fold AND b.recipe = 'r0' WHERE a.recipe <> 'r0') SELECT model, recipe, CAST(sum(CASE WHEN delta > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, count(*) AS folds, round(avg(delta), 6) AS mean_delta FROM d GROUP BY 1, 2")
def fold_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.fold_metrics(predictions(spark, sf_dir), LABELS, _KEYS)
    return rounded(evaluation.fold_wins(evaluation.fold_deltas(m, "recipe", "r0", ["model", "fold"], "macro_f1"), ["model", "recipe"]), "mean_delta")


@query(f"{_PRF}, z AS (SELECT * FROM s WHERE support > 0 OR named > 0) SELECT model, recipe, fold, round(avg(f1), 6) AS macro_f1_present, count(*) AS labels FROM z GROUP BY ALL")
def macro_f1_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.macro_f1_present(predictions(spark, sf_dir), LABELS, _KEYS), "macro_f1_present")


@query(f"WITH {PREDICTIONS}, n AS (SELECT fold, true_label, count(*) AS n FROM q GROUP BY 1, 2) SELECT fold, true_label, n, round(CAST(sum(n) OVER (PARTITION BY fold) AS DOUBLE) / (count(*) OVER (PARTITION BY fold) * n), 6) AS weight FROM n")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.balanced_weights(predictions(spark, sf_dir), "true_label", ["fold"]), "weight")


@query(f"WITH {PREDICTIONS}, f AS (SELECT DISTINCT fold FROM q), n AS (SELECT f.fold, q.true_label, count(*) AS n FROM f JOIN q ON q.fold <> f.fold GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, true_label) AS k FROM n) SELECT fold, true_label AS majority FROM k WHERE k = 1")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.majority_baseline(predictions(spark, sf_dir), "true_label", "fold")


@query("""WITH d AS (SELECT p_partkey AS id, p_partkey % 4 AS fold, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS x FROM part) SELECT id, round(coalesce(x, (SELECT quantile_cont(x, 0.5) FROM d WHERE fold <> 1)), 6) AS x FROM d""")
def median_imputer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(k.alias("id"), (k % 4).alias("fold"), F.when(k % 6 != 0, F.col("p_retailprice")).alias("x"))
    return rounded(evaluation.median_imputer(d, ["x"], "fold", 1).select("id", "x"), "x")


_DOC = "d AS (SELECT documents.doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels ON labels.doc_id = documents.doc_id)"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH {_DOC}, t AS (SELECT 'all' AS tier, * FROM d UNION ALL SELECT 'long', * FROM d WHERE n_chars >= 2000 UNION ALL SELECT 'good', * FROM d WHERE quality = 1) SELECT tier, count(*) AS n, round(avg(CASE WHEN CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0 END = quality THEN 1.0 ELSE 0 END), 6) AS agreement FROM t GROUP BY 1""")
def tier_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = {"all": F.lit(True), "long": F.col("n_chars") >= 2000, "good": F.col("quality") == 1}
    return rounded(evaluation.agreement(_labelled(spark, sf_dir), tiers, "quality", "lang", {"en": 1, "de": 0}), "agreement")


_AUDIT = """a AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' WHEN doc_id % 13 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 17 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars, CAST(CASE WHEN doc_id % 19 = 0 THEN 2 ELSE 1 END AS INTEGER) AS q FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT -1, 'en', 5, 1 UNION ALL SELECT 1, 'en', (SELECT n_chars FROM documents WHERE doc_id = 1), 1),
i AS (SELECT doc_id AS id, 'doc_id' AS field, 'error' AS severity, 'unknown_id' AS issue, CAST(doc_id AS VARCHAR) AS value FROM a WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'doc_id', 'error', 'missing_id', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)
  UNION ALL SELECT doc_id, 'doc_id', 'error', 'duplicate_id', CAST(doc_id AS VARCHAR) FROM (SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS n FROM a) WHERE n > 1 UNION ALL SELECT doc_id, 'lang', 'warning', 'missing_label', '' FROM a WHERE trim(lang) = '' UNION ALL SELECT doc_id, 'lang', 'error', 'label_not_in_codebook', trim(lang) FROM a WHERE trim(lang) NOT IN ('', 'en', 'de', 'fr', 'es')
  UNION ALL SELECT doc_id, 'q', 'error', 'bad_quality', CAST(q AS VARCHAR) FROM a WHERE q NOT IN (0, 1) UNION ALL SELECT a.doc_id, 'n_chars', 'error', 'fixed_field_changed', CAST(a.n_chars AS VARCHAR) FROM a JOIN documents d ON d.doc_id = a.doc_id WHERE a.n_chars IS DISTINCT FROM d.n_chars)"""


def _audit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    k = F.col("doc_id")
    own = docs.filter(k % 5 != 0).select("doc_id", F.when(k % 9 == 0, " ").when(k % 13 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(k % 17 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"), F.when(k % 19 == 0, 2).otherwise(1).alias("q"))
    more = spark.createDataFrame([(-1, "en", 5, 1)], own.schema)
    again = docs.filter("doc_id = 1").select("doc_id", F.lit("en").alias("lang"), "n_chars", F.lit(1).alias("q"))
    return own.unionByName(more).unionByName(again), docs


@query(f"WITH {_AUDIT} SELECT * FROM i")
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, docs = _audit(spark, sf_dir)
    return audit.audit_issues(own, docs, "doc_id", "lang", ["en", "de", "fr", "es"], "q", ["n_chars"])


@query(f"WITH {_AUDIT} SELECT (SELECT count(*) FROM i WHERE severity = 'error') AS errors, (SELECT count(*) FROM i WHERE severity = 'warning') AS warnings, (SELECT count(*) FROM a) AS rows, (SELECT count(*) FROM a WHERE trim(lang) <> '') AS labelled, 'blocked' AS status")
def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, docs = _audit(spark, sf_dir)
    return audit.audit_status(audit.audit_issues(own, docs, "doc_id", "lang", ["en", "de", "fr", "es"], "q", ["n_chars"]), own, "lang")


@query(f"""WITH {_DOC}, s AS (SELECT doc_id, (n_chars % 100) / 100.0::DOUBLE AS confidence, lang, toxic, quality FROM d), p AS (SELECT *, 2.5 * (1 - confidence) + CASE WHEN toxic = 1 THEN 3 ELSE 0 END + CASE WHEN lang <> 'en' THEN 1.5 ELSE 0 END + CASE WHEN quality = 0 THEN 2 ELSE 0 END AS score FROM s), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, confidence, doc_id) AS rank FROM p)
SELECT doc_id, confidence, round(score, 6) AS score, concat_ws(';', CASE WHEN 2.5 * (1 - confidence) >= 0.75 THEN 'low_confidence' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN quality = 0 THEN 'poor' END) AS reasons, rank, CASE WHEN rank <= 150 THEN 'pass_1' WHEN rank <= 350 THEN 'pass_2' ELSE 'pass_3' END AS audit_pass FROM k""")
def priority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir).withColumn("confidence", (F.col("n_chars") % 100) / 100.0)
    return rounded(audit.priority(d, "doc_id", "confidence", [("toxic", 3, F.col("toxic") == 1), ("foreign", 1.5, F.col("lang") != "en"), ("poor", 2, F.col("quality") == 0)]), "score")


@query(r"""SELECT p_partkey, array_to_string(regexp_extract_all(strip_accents(lower(trim(p_name))), '[a-z0-9]+'), ' ') AS name, coalesce(TRY_CAST(replace(replace(CAST(p_size AS VARCHAR) || ',5', ' ', ''), ',', '.') AS DOUBLE), 0) AS area FROM part""")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.normalise_text(F.col("p_name")).alias("name"), S.comma_area(F.concat(F.col("p_size").cast("string"), F.lit(",5"))).alias("area"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN value WHEN event_id % 4 = 2 THEN CAST(event_id AS DOUBLE) END AS number FROM events""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 8 == 0, "NaN").when(k % 4 == 0, "abc").when(k % 4 == 1, F.col("value").cast("string")).when(k % 4 == 2, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).otherwise("inf")
    return table(spark, sf_dir, "events").select("event_id", S.parse_number(text).alias("number"))


@query()
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 25).alias("block"), S.normalise_text(F.col("p_name")).alias("name"))
    left, right = part.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "site"), part.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "supply")
    return matching.best_matches(left, right, "block", "site", "supply")
