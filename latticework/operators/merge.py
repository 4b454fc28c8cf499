"""Keyed merges of feature tables, all columns strings and "" standing for null within the merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import scalar as S


def last_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in order (a later duplicate replaces an earlier one)."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v"))
    return best.select(key, *[F.col(f"v.{c}").alias(c) for c in rest])


def override_merge(base: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join in which a matched row's right columns replace base columns of the same name, empty or not; order: base, then new."""
    other = right.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != key], F.lit(True).alias("_hit"))
    joined = base.join(other, F.col(key) == F.col("_key"), "left")
    new = [c for c in right.columns if c not in base.columns]

    def pick(c: str) -> Column:
        return F.when(F.col("_hit"), F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) if c in right.columns and c != key else F.col(c)

    return joined.select(*[pick(c) for c in base.columns], *[F.col(f"_r_{c}").alias(c) for c in new])


def merge_chain(base: DataFrame, inputs: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda left, right: override_merge(left, right, key), inputs, base)


def join_loss(base: DataFrame, inputs: dict[str, DataFrame], key: str) -> DataFrame:
    """Per input: base keys without a row there, and its keys that the base lacks."""
    parts = []
    for name, right in inputs.items():
        lost = base.join(right, key, "left_anti").select(F.lit(1).alias("missing"), F.lit(0).alias("extra"))
        extra = right.join(base, key, "left_anti").select(F.lit(0).alias("missing"), F.lit(1).alias("extra"))
        none = base.sparkSession.range(1).select(F.lit(0).alias("missing"), F.lit(0).alias("extra"))
        parts.append(lost.unionByName(extra).unionByName(none).withColumn("input", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).groupBy("input").agg(F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))


def require_one_to_one(df: DataFrame, key: str) -> DataFrame:
    """The table; an error if a key occurs twice."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {[r[key] for r in twice]}")
    return df


def any_flag(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """name = "1" where a column is the text "1" exactly, else "0"; columns that df doesn't have count as "0"."""
    tests = [F.coalesce(F.col(c).cast("string") == "1", F.lit(False)) for c in columns if c in df.columns]
    return df.withColumn(name, F.when(reduce(lambda a, b: a | b, tests, F.lit(False)), "1").otherwise("0"))


def presence_flags(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """For each name a flag "1" where its column is a number above 0, else "0"."""
    return df.select("*", *[F.when(F.coalesce(S.parse_number(F.col(c)), F.lit(0.0)) > 0, "1").otherwise("0").alias(name) for name, c in flags.items()])


def permeability(df: DataFrame) -> DataFrame:
    """Derived street fields: presence flags and the two permeability proxies, from text or numeric columns."""

    def number(c: str) -> Column:
        return S.parse_number(F.col(c))

    road, nodes = F.coalesce(number("road_length"), F.lit(0.0)), F.coalesce(number("nodes"), F.lit(0.0))
    crossing, dead, open_share = F.coalesce(number("intersections"), F.lit(0.0)), number("dead_end_share"), number("open_share")
    penalty = F.when(dead.isNotNull(), S.clamp01(1 - dead)).otherwise(F.lit(0.0))
    network = F.when(nodes > 0, S.clamp01((S.clamp01(crossing / nodes) + penalty) / 2)).otherwise(F.lit(0.0))
    street = F.when(open_share.isNotNull(), S.clamp01(open_share) * network).when(road <= 0, F.lit(0.0))
    return df.select("*", (road > 0).cast("int").alias("road_flag"), F.col("continuity").isNotNull().cast("int").alias("continuity_flag"), network.alias("network_proxy"), street.alias("street_proxy"))
