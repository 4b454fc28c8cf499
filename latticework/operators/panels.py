"""Panel tables: populations, contexts, crosswalks, comparisons and set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking


def modelling_population(df: DataFrame, label: str, confidence: str, labels: list, least_confidence: float = 0.6, least_rows: int = 100) -> DataFrame:
    """Rows with a label of the list and enough confidence, of labels that then have ``least_rows`` or more."""
    sure = df.filter(F.col(label).isin(labels) & (F.col(confidence) >= least_confidence))
    frequent = sure.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least_rows).select(label)
    return sure.join(frequent, label, "left_semi")


def context_pivot(df: DataFrame, cells: DataFrame, keys: list[str], kind: str, kinds: list[str], value: Column) -> DataFrame:
    """Sum per cell and kind, one column each, 0 where there is none."""
    wide = df.groupBy(*keys).pivot(kind, kinds).agg(F.sum(value))
    return cells.select(*keys).join(wide, keys, "left").fillna(0, kinds)


def smallest_region(points: DataFrame, regions: DataFrame, key: str, size: int) -> DataFrame:
    """The smallest rectangle (id, x0, y0, x1, y1) that holds each point, its edge included; of equals the smallest id, null if none.

    Rectangles are dealt to the lattice cells they touch, so the join is on cells.  Points of one place have one answer, and of equal
    rectangles only the first can be it, so both are met once.
    """
    def upto(a: str, b: str) -> Column:
        return F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long"))

    alone = regions.groupBy("x0", "y0", "x1", "y1").agg(F.min("id").alias("id"))
    spread = alone.select("id", "x0", "y0", "x1", "y1", F.explode(upto("y0", "y1")).alias("r")).select("*", F.explode(upto("x0", "x1")).alias("c"))
    own = points.select("x", "y").distinct().select("x", "y", F.floor(F.col("y") / size).cast("long").alias("r"), F.floor(F.col("x") / size).cast("long").alias("c"))
    inside = own.join(spread, ["r", "c"]).filter("x >= x0 AND x <= x1 AND y >= y0 AND y <= y1")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = inside.groupBy("x", "y").agg(F.min(F.struct(area.alias("area"), "id")).alias("m"))
    return points.select(key, "x", "y").join(best, ["x", "y"], "left").select(key, F.col("m.id").alias("region"), F.col("m.area").alias("area"))


def warning_scores(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, deviation and 95th percentile of the warning score 1 - probability, and the share of wrong labels."""
    own = pred.withColumn("_w", 1 - F.col("probability"))
    wrong = (F.col("true_label") != F.col("predicted_label")).cast("double")
    out = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_w").alias("mean"), F.stddev_samp("_w").alias("sd"), F.avg(wrong).alias("disagreement"))
    high = ranking.quantiles(own, ["_w"], keys, [0.95]).select(*keys, F.col("q")[0].alias("q95"))
    return ranking.join_group(out, high, keys).select(*keys, "n", "mean", "sd", "q95", "disagreement")


def crosswalk(df: DataFrame, label: str, output: str, confidence: str) -> DataFrame:
    """Rows and mean confidence of each label and output; null is a label like any other."""
    return df.groupBy(label, output).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"))


def composition(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def change_shares(df: DataFrame, before: str, after: str, group: list[str], tolerance: float = 1e-9) -> DataFrame:
    d = F.col(after) - F.col(before)
    return df.groupBy(*group).agg(F.avg((d > tolerance).cast("double")).alias("gain"), F.avg((d < -tolerance).cast("double")).alias("loss"), F.avg((F.abs(d) <= tolerance).cast("double")).alias("flat"))


def collapse(df: DataFrame, key: str, first: list[str], total: list[str], top: list[str], order: str) -> DataFrame:
    """One row per key: first values in order, sums, maxima and the number of rows."""
    return df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in first], *[F.sum(c).alias(c) for c in total], *[F.max(c).alias(c) for c in top], F.count(F.lit(1)).alias("rows"))


def compare_counts(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Counts and sums of two sources per key of the left, with the ratio of counts."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_n"), F.sum(value).alias("left_sum"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_n"), F.sum(value).alias("right_sum"))
    both = a.join(b, key, "left").fillna(0, ["right_n", "right_sum"])
    return both.withColumn("ratio", F.try_divide(F.col("right_n"), F.col("left_n")))


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many distinct keys are in both, only in the first and only in the second."""
    marked = a.select(key).distinct().withColumn("a", F.lit(1)).unionByName(b.select(key).distinct().withColumn("b", F.lit(1)), allowMissingColumns=True)
    each = marked.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_first"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_second"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def capped_sample(df: DataFrame, group: str, key: str, cap: int) -> DataFrame:
    """At most ``cap`` rows per group, in order of the MD5 of the key (the cap is the operator's purpose)."""
    order = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= cap).drop("_k")


def citations(texts: DataFrame, text: str, pattern: str, known: DataFrame, key: str) -> DataFrame:
    """Keys cited by a pattern with their counts, and whether each is known."""
    found = texts.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return found.join(known.select(key).distinct().withColumn("_k", F.lit(1)), key, "left").select(key, "n", F.coalesce("_k", F.lit(0)).alias("known"))


def scaled(df: DataFrame, value: str, group: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Value scaled between the group's percentiles and clipped to [0, 1]."""
    q = ranking.quantiles(df, [value], group, [low, high]).select(*group, "q")
    at = F.try_divide(F.col(value) - F.col("q")[0], F.col("q")[1] - F.col("q")[0])
    return ranking.join_group(df, q, group).withColumn("scaled", F.when(at.isNotNull(), F.least(F.greatest(at, F.lit(0.0)), F.lit(1.0)))).drop("q")
