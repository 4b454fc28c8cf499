"""Picking rows: medoids, exclusive top-k per category, stratified samples, quartile gates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import join_few, quantiles, wide_quantiles


def centre_scores(df: DataFrame, group: str, columns: list[str], key: str) -> DataFrame:
    """Sum of squared distances from the group's medians in population deviations (1 where that is 0 or undefined)."""
    middle = wide_quantiles(df, columns, [group], [0.5]).select(group, *[F.col(f"q_{c}")[0].alias(f"m_{c}") for c in columns])
    stats = middle.join(df.groupBy(group).agg(*[F.stddev_pop(c).alias(f"s_{c}") for c in columns]), group)
    joined = join_few(df, stats, [group])

    def term(c: str) -> Column:
        s = F.when((F.col(f"s_{c}") > 0) & ~F.isnan(f"s_{c}"), F.col(f"s_{c}")).otherwise(F.lit(1.0))
        z = (F.col(c) - F.col(f"m_{c}")) / s
        return z * z

    return joined.select(*df.columns, reduce(lambda a, b: a + b, [term(c) for c in columns]).alias("score"))


def medoids(df: DataFrame, group: str, columns: list[str], key: str, exclude: DataFrame | None = None) -> DataFrame:
    """The row nearest to its group's centre, smallest key first; statistics come before the exclusion."""
    scored = centre_scores(df, group, columns, key)
    scored = scored.join(exclude.select(key), key, "left_anti") if exclude is not None else scored
    return scored.groupBy(group).agg(F.min(F.struct("score", key)).alias("m")).select(group, F.col(f"m.{key}").alias(key), F.col("m.score").alias("score"))


def quartile_gate(df: DataFrame, value: str, group: str) -> DataFrame:
    """cool at or below the group's lower quartile, hot at or above the upper, else between."""
    q = quantiles(df, [value], [group], [0.25, 0.75]).select(group, "q")
    gate = F.when(F.col(value) <= F.col("q")[0], "cool").when(F.col(value) >= F.col("q")[1], "hot").otherwise("between")
    return join_few(df, q, [group]).withColumn("gate", gate).drop("q")


def exclusive_top(df: DataFrame, key: str, categories: list[tuple[str, Callable[[DataFrame], DataFrame], list[Column], int]]) -> DataFrame:
    """First n rows of each category in turn, of the rows that no earlier category took.

    Each category is (name, filter, order, n).  What is held between steps are the n keys of each category, a fixed number.
    """
    used: list = []
    parts = []
    for name, keep, order, n in categories:
        rest = keep(df)
        rest = rest.filter(~F.col(key).isin(used)) if used else rest
        picked = rest.orderBy(*order, key).limit(n).select(key).collect()
        parts += [(name, r[key], k + 1) for k, r in enumerate(picked)]
        used += [r[key] for r in picked]
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(parts, f"category string, {key} {kind}, position long")


def stratified_sample(df: DataFrame, strata: list[str], key: str, target: int, least: int) -> DataFrame:
    """min(size, max(least, target * size / all, half to even)) rows per stratum in order of the MD5 of the key."""
    stratum = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in strata])
    own = df.select(key, stratum.alias("stratum"), F.md5(F.col(key).cast("string")).alias("h"))
    sizes = own.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.withColumn("wanted", F.least("size", F.greatest(F.lit(least), F.rint(F.lit(float(target)) * F.col("size") / F.sum("size").over(Window.partitionBy())).cast("long"))))
    sizes = sizes.withColumn("role", F.when(F.col("size") <= least, "certainty_rare").otherwise("random_audit"))
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("h", key)))
    return ranked.join(sizes, "stratum").filter(F.col("k") <= F.col("wanted")).select("stratum", key, "role", F.col("k").cast("long").alias("position"))
