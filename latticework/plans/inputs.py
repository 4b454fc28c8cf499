"""Driver tables as the roles that operators expect; geometry comes from integer arithmetic on keys, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, ROWS, COLS = 250, 20, 20
CELL_AREA = float(SIZE * SIZE)
CELL = ["row_id", "col_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles are rounded as in SQL, by what they are times 10^digits; F.round goes by their decimal digits, which differs at ties."""
    kinds = dict(df.dtypes)

    def one(c: str):
        return (F.round(F.col(c) * 10.0**digits) / 10.0**digits if kinds[c] == "double" else F.round(F.col(c), digits)).alias(c)

    return df.select(*[one(c) if c in names else F.col(c) for c in df.columns])


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x0, y0 = (k * 7919 % 5000).cast("double"), (k * 104729 % 5000).cast("double")
    kind = F.when(k % 4 == 0, "mesken").when(k % 4 == 1, "isyeri").when(k % 4 == 2, "kamu")
    return table(spark, sf_dir, "part").select(k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + 10 + k % 90).alias("x1"), (y0 + 10 + k * 13 % 70).alias("y1"), F.when(k % 11 != 0, F.col("p_size") * 2 - 10).alias("floors"), kind.alias("type"))


BUILDINGS = """b AS (SELECT p_partkey AS id, CAST(p_partkey * 7919 % 5000 AS DOUBLE) AS x0, CAST(p_partkey * 104729 % 5000 AS DOUBLE) AS y0,
  CAST(p_partkey * 7919 % 5000 AS DOUBLE) + 10 + p_partkey % 90 AS x1, CAST(p_partkey * 104729 % 5000 AS DOUBLE) + 10 + p_partkey * 13 % 70 AS y1,
  CASE WHEN p_partkey % 11 <> 0 THEN p_size * 2 - 10 END AS floors,
  CASE p_partkey % 4 WHEN 0 THEN 'mesken' WHEN 1 THEN 'isyeri' WHEN 2 THEN 'kamu' END AS type FROM part),
cells AS (SELECT r.range AS row_id, c.range AS col_id FROM range(20) r, range(20) c),
o AS (SELECT b.*, row_id, col_id, least(x1, (col_id + 1) * 250.0::DOUBLE) - greatest(x0, col_id * 250.0::DOUBLE) AS w, least(y1, (row_id + 1) * 250.0::DOUBLE) - greatest(y0, row_id * 250.0::DOUBLE) AS h
  FROM b, cells WHERE x0 < (col_id + 1) * 250 AND x1 > col_id * 250 AND y0 < (row_id + 1) * 250 AND y1 > row_id * 250),
p AS (SELECT *, w * h AS area FROM o)"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    x0, y0 = (k * 7919 % 5000).cast("double"), (k * 104729 % 5000).cast("double")
    return table(spark, sf_dir, "orders").select(k.alias("id"), x0.alias("x0"), y0.alias("y0"), (x0 + k * 31 % 301 - 150).alias("x1"), (y0 + k * 17 % 307 - 150).alias("y1"), F.col("o_orderpriority").alias("kind"))


ROADS = """s AS (SELECT o_orderkey AS id, CAST(o_orderkey * 7919 % 5000 AS DOUBLE) AS x0, CAST(o_orderkey * 104729 % 5000 AS DOUBLE) AS y0,
  CAST(o_orderkey * 7919 % 5000 AS DOUBLE) + o_orderkey * 31 % 301 - 150 AS x1, CAST(o_orderkey * 104729 % 5000 AS DOUBLE) + o_orderkey * 17 % 307 - 150 AS y1, o_orderpriority AS kind FROM orders)"""
PIECES = (
    ROADS
    + """, cells AS (SELECT r.range AS row_id, c.range AS col_id FROM range(20) r, range(20) c),
c AS (SELECT s.*, row_id, col_id, x1 - x0 AS dx, y1 - y0 AS dy, col_id * 250.0::DOUBLE AS cx0, (col_id + 1) * 250.0::DOUBLE AS cx1, row_id * 250.0::DOUBLE AS cy0, (row_id + 1) * 250.0::DOUBLE AS cy1
  FROM s, cells WHERE least(x0, x1) < (col_id + 1) * 250 AND greatest(x0, x1) >= col_id * 250 AND least(y0, y1) < (row_id + 1) * 250 AND greatest(y0, y1) >= row_id * 250),
t AS (SELECT *, CASE WHEN dx = 0 THEN CASE WHEN x0 >= cx0 AND x0 < cx1 THEN 0.0 ELSE 2.0 END ELSE least((cx0 - x0) / dx, (cx1 - x0) / dx) END AS ax,
  CASE WHEN dx = 0 THEN CASE WHEN x0 >= cx0 AND x0 < cx1 THEN 1.0 ELSE -1.0 END ELSE greatest((cx0 - x0) / dx, (cx1 - x0) / dx) END AS bx,
  CASE WHEN dy = 0 THEN CASE WHEN y0 >= cy0 AND y0 < cy1 THEN 0.0 ELSE 2.0 END ELSE least((cy0 - y0) / dy, (cy1 - y0) / dy) END AS ay,
  CASE WHEN dy = 0 THEN CASE WHEN y0 >= cy0 AND y0 < cy1 THEN 1.0 ELSE -1.0 END ELSE greatest((cy0 - y0) / dy, (cy1 - y0) / dy) END AS by_ FROM c),
p AS (SELECT *, sqrt(dx * dx + dy * dy) * (least(1.0, bx, by_) - greatest(0.0, ax, ay)) AS length FROM t WHERE sqrt(dx * dx + dy * dy) * (least(1.0, bx, by_) - greatest(0.0, ax, ay)) > 1e-9)"""
)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k.alias("px"), (k * 7919 % 5000).cast("double").alias("x"), (k * 104729 % 5000).cast("double").alias("y"), "value", (F.length("event_type") * 10 % 70 + 10).cast("long").alias("code"), F.col("event_type").alias("label"))


PIXELS = """e AS (SELECT event_id AS px, value, event_type AS label, CAST(length(event_type) * 10 % 70 + 10 AS BIGINT) AS code,
  CAST(floor(event_id * 104729 % 5000 / 250.0) AS BIGINT) AS row_id, CAST(floor(event_id * 7919 % 5000 / 250.0) AS BIGINT) AS col_id FROM events)"""


def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("origin_id"), (k * 7919 % 5000).cast("double").alias("x"), (k * 104729 % 5000).cast("double").alias("y"), F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("population"), F.col("c_nationkey").alias("zone"))


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("supply_id"), (k * 6151 % 5000).cast("double").alias("x"), (k * 3079 % 5000).cast("double").alias("y"), F.abs("s_acctbal").alias("capacity"))


ACCESS = """a AS (SELECT c_custkey AS origin_id, CAST(c_custkey * 7919 % 5000 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 5000 AS DOUBLE) AS y, greatest(c_acctbal, 0.0) AS population, c_nationkey AS zone FROM customer),
u AS (SELECT s_suppkey AS supply_id, CAST(s_suppkey * 6151 % 5000 AS DOUBLE) AS x, CAST(s_suppkey * 3079 % 5000 AS DOUBLE) AS y, abs(s_acctbal) AS capacity FROM supplier)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table of numeric columns by supplier."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("grid_id"))
    out = li.agg(F.count(F.lit(1)).alias("osm_count"), F.sum("l_quantity").alias("building_quantity"), F.sum("l_extendedprice").alias("road_price"), F.avg("l_discount").alias("lst_discount"), F.avg("l_tax").alias("canopy_tax"), F.max("l_linenumber").cast("double").alias("morph_lines"))
    return out.withColumn("dw_gap", F.when(F.col("grid_id") % 7 != 0, F.round("canopy_tax", 3)))


WIDE = """w0 AS (SELECT l_suppkey AS grid_id, count(*) AS osm_count, sum(l_quantity) AS building_quantity, sum(l_extendedprice) AS road_price, avg(l_discount) AS lst_discount, avg(l_tax) AS canopy_tax, CAST(max(l_linenumber) AS DOUBLE) AS morph_lines FROM lineitem GROUP BY 1),
w AS (SELECT *, CASE WHEN grid_id % 7 <> 0 THEN round(canopy_tax, 3) END AS dw_gap FROM w0)"""

LABELS = ["A", "N", "R"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and prediction per line item: model is the line status, recipe the ship mode's first letter."""
    guess = F.when(F.col("l_partkey") % 5 == 0, F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("R")).otherwise(F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("model"), F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string")).alias("recipe"), (F.col("l_orderkey") % 5).alias("fold"), F.col("l_returnflag").alias("true_label"), guess.alias("predicted_label"), (1 - F.col("l_discount")).alias("probability"))


PREDICTIONS = """q AS (SELECT l_linestatus AS model, 'r' || CAST(l_suppkey % 3 AS VARCHAR) AS recipe, l_orderkey % 5 AS fold, l_returnflag AS true_label,
  CASE WHEN l_partkey % 5 = 0 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'R' END ELSE l_returnflag END AS predicted_label, 1 - l_discount AS probability FROM lineitem)"""
