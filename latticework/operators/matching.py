"""Best fuzzy match inside blocks, by the ratio of matching blocks (twice the matched characters over both lengths)."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import cut


@F.pandas_udf(T.DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(x: Column) -> Column:
    """How often each letter of ALPHABET stands in the text, and all other characters together."""
    own = [F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))) for c in ALPHABET]
    return F.array(*own, F.length(F.translate(x, ALPHABET, "")))


def most_similar(a: str, b: str) -> Column:
    """No less than the similarity of two texts, from their letter counts: matched characters are of the same letter."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    whole = F.aggregate(F.concat(a, b), F.lit(0), lambda s, x: s + x)
    return F.when(whole > 0, 2.0 * common / whole).otherwise(1.0)


def best_matches(left: DataFrame, right: DataFrame, block: str, left_key: str, right_key: str, name: str = "name") -> DataFrame:
    """Each left row's best right row of its block (of equals the smallest key), its similarity and status.

    Equal names need no scoring; each distinct pair of names in a block is bounded by its letter counts first.  The pair with the highest
    bound is scored, and then only pairs whose bound isn't below that score, so that most pairs never reach the matcher.
    """
    l = left.select(F.col(block), F.col(name).alias("l_name")).distinct().withColumn("l_n", letter_counts(F.coalesce("l_name", F.lit(""))))  # noqa: E741
    r = right.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy(block, F.col(name).alias("r_name")).agg(F.min(right_key).alias(right_key)).withColumn("r_n", letter_counts(F.col("r_name")))
    pairs = cut(l.join(r, block).withColumn("bound", F.when(F.col("l_name") == F.col("r_name"), 2.0).otherwise(most_similar("l_n", "r_n"))).drop("l_n", "r_n").filter("bound > 0"))
    score = F.when(F.col("l_name") == F.col("r_name"), F.lit(1.0)).otherwise(similarity("l_name", "r_name"))
    first = pairs.groupBy(block, "l_name").agg(F.max_by("r_name", F.struct("bound", "r_name")).alias("r_name"))
    floor = first.select(F.col(block).alias("_block"), F.col("l_name").alias("_name"), score.alias("floor"))
    left_over = pairs.join(floor, F.col(block).eqNullSafe(F.col("_block")) & F.col("l_name").eqNullSafe(F.col("_name"))).filter(F.col("bound") >= F.col("floor") - 1e-9)
    best = left_over.withColumn("score", score).filter("score > 0").groupBy(block, "l_name").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(right_key))).alias("m"))
    out = left.select(left_key, block, F.col(name).alias("l_name")).join(best, [block, "l_name"], "left")
    s = F.coalesce(-F.col("m.s"), F.lit(0.0))
    status = F.when(s >= 0.999, "exact_normalized").when(s >= 0.82, "strong_candidate").when(s >= 0.68, "possible_candidate").otherwise("unmatched")
    return out.select(left_key, F.col(f"m.{right_key}").alias(right_key), F.round(s, 6).alias("similarity"), status.alias("status"), (status != "exact_normalized").cast("int").alias("review"))
