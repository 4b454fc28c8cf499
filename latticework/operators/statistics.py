"""Ranks, bins and tests over columns of a DataFrame; exact quantiles throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import tails

from . import ranking


def rank_bins(df: DataFrame, value: str, order: str, bins: int, group: list[str] | None = None, name: str = "bin") -> DataFrame:
    """Equal-count bins 1..bins of the rank by value, then order; edges are linear quantiles of the ranks in double arithmetic."""
    ranked = ranking.row_numbers(df, [value, order], group or [], "_r")
    above = sum((F.col("_r") > 1 + (F.col("_r_of") - 1) * F.lit(k / bins * 100 / 100)).cast("int") for k in range(1, bins))
    return ranked.withColumn(name, (above + 1).cast("long")).drop("_r", "_r_of")


def named_terciles(df: DataFrame, value: str, order: str, eligible: Column, names: tuple[str, ...] = ("low", "medium", "high"), name: str = "bin") -> DataFrame:
    """Bins of equal count over the eligible rows with a value; all of them are unbinned where there are fewer distinct values than bins, other rows are edge."""
    own = df.withColumn("_ok", eligible & F.col(value).isNotNull())
    distinct = own.filter("_ok").agg(F.count_distinct(value).alias("_distinct"))
    binned = rank_bins(own.filter("_ok"), value, order, len(names), name="_bin").crossJoin(F.broadcast(distinct))
    label = F.when(F.col("_distinct") < len(names), "unbinned").otherwise(F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_bin").cast("int")))
    return binned.select(*df.columns, label.alias(name)).unionByName(own.filter(~F.coalesce(F.col("_ok"), F.lit(False))).select(*df.columns, F.lit("edge").alias(name)))


def trend_bins(df: DataFrame, x: str, y: str, order: str, group: list[str], per_bin: int = 80, least: int = 30, most: int = 8) -> DataFrame:
    """Per group and equal-count bin of x: n, median of x, quartiles of y.

    A group has n // ``per_bin`` bins, 3 at least and ``most`` at most; groups under ``least`` rows or of fewer than four x are left out.
    """
    own = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = ranking.value_counts(own, x, group).groupBy(*group).agg(F.max("total_n").alias("_n"), F.count(F.lit(1)).alias("_distinct"))
    bins = counts.filter((F.col("_n") >= least) & (F.col("_distinct") >= 4)).select(*group, F.least(F.lit(most), F.greatest(F.lit(3), F.floor(F.col("_n") / per_bin))).cast("int").alias("_bins"))
    ranked = ranking.row_numbers(own.select(*group, x, y, order), [x, order], group, "_r")
    ranked = ranked.alias("l").join(F.broadcast(bins).alias("r"), ranking.same("l", "r", group)).select("l.*", "r._bins")
    edge = F.filter(F.sequence(F.lit(1), F.col("_bins") - 1), lambda k: F.col("_r") > 1 + (F.col("_r_of") - 1) * (k / F.col("_bins")))
    binned = ranked.withColumn("bin", (F.size(edge) + 1).cast("long"))
    q = ranking.wide_quantiles(binned, [x, y], [*group, "bin"], [0.25, 0.5, 0.75])
    n = binned.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    return ranking.join_group(n, q, [*group, "bin"]).select(*group, "bin", "n", F.col(f"q_{x}")[1].alias("x_median"), F.col(f"q_{y}")[0].alias("y_q25"), F.col(f"q_{y}")[1].alias("y_median"), F.col(f"q_{y}")[2].alias("y_q75"))


def spearman(df: DataFrame, a: str, b: str, group: list[str]) -> DataFrame:
    """Rank correlation per group, its t statistic, and the two-sided p-value of Student's t with n - 2 degrees of freedom (null below three rows)."""
    ranked = ranking.average_ranks(ranking.average_ranks(df.select(*group, a, b), a, group, "ra"), b, group, "rb")
    out = ranked.groupBy(*group).agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    return out.withColumn("t", t).withColumn("p_value", F.when(F.abs("rho") >= 1, 0.0).otherwise(tails.student_tail(F.col("t"), F.col("n") - 2)))


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """H with tie correction, epsilon squared and the p-value of chi square with one degree less than groups, from counts per value and group: ranks come from running sums over distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value, group).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranking.value_counts(df, value, []).select(value, F.col("n").alias("t"), "total_n", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"))
    ties = ranked.agg(F.max("total_n").cast("double").alias("N"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    sums = counts.join(ranked, value).groupBy(group).agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("n"))
    agg = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k")).crossJoin(ties)
    n = F.col("N")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return agg.select(h.alias("h"), F.col("k").alias("groups"), F.greatest((h - F.col("k") + 1) / (n - F.col("k")), F.lit(0.0)).alias("epsilon2"), tails.chi_square_tail(h, F.col("k") - 1).alias("p_value"))


def ks_two_sample(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Largest distance of the two empirical distributions, and its p-value (exact for small samples); ``first`` tells the samples apart."""
    run = ranking.value_counts(df, value, [], {"a": F.sum(first.cast("long")), "b": F.sum((~first).cast("long"))})
    share = {s: (F.col(f"before_{s}") + F.col(s)) / F.col(f"total_{s}") for s in "ab"}
    d = run.agg(F.max(F.abs(share["a"] - share["b"])).alias("d"), F.max("total_a").alias("n_a"), F.max("total_b").alias("n_b"))
    return d.withColumn("p_value", tails.two_sample_tail(F.col("d"), F.col("n_a"), F.col("n_b")))


def log_correlation_left_out(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Pearson correlation of log1p values: all rows, and the range when each key is left out, from sums less that key's own."""
    x, y = F.log1p(a), F.log1p(b)
    moments = {"n": F.count(F.lit(1)), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "syy": F.sum(y * y), "sxy": F.sum(x * y)}
    own = df.groupBy(key).agg(*[v.alias(k) for k, v in moments.items()])
    whole = Window.partitionBy()
    both = own.select(*[F.col(k) for k in moments], *[F.sum(k).over(whole).alias(f"t_{k}") for k in moments])

    def corr(m: dict[str, Column]) -> Column:
        return (m["n"] * m["sxy"] - m["sx"] * m["sy"]) / F.sqrt((m["n"] * m["sxx"] - m["sx"] * m["sx"]) * (m["n"] * m["syy"] - m["sy"] * m["sy"]))

    full, rest = corr({k: F.col(f"t_{k}") for k in moments}), corr({k: F.col(f"t_{k}") - F.col(k) for k in moments})
    return both.select(full.alias("f"), rest.alias("r")).agg(F.max("f").alias("r_all"), F.min("r").alias("r_min"), F.max("r").alias("r_max"))


def ols_line(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Quartiles, and whiskers at the fences, held inside the data's range."""
    found = ranking.quantiles(df, [value], group, [0.0, 0.25, 0.5, 0.75, 1.0])
    q = F.col("q")
    reach = (q[3] - q[1]) * 1.5
    return found.select(*group, q[1].alias("q25"), q[2].alias("median"), q[3].alias("q75"), F.greatest(q[0], q[1] - reach).alias("low_whisker"), F.least(q[4], q[3] + reach).alias("high_whisker"))


def ecdf(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Distinct values of each group with the share of rows at or below."""
    return ranking.value_counts(df, value, group).select(*group, value, ((F.col("before_n") + F.col("n")) / F.col("total_n")).alias("ecdf"))


def access_tiers(df: DataFrame, value: str) -> DataFrame:
    """df with tier: none at 0 or below, low up to the median of the positive values, else high."""
    positive = ranking.quantiles(df.filter(F.col(value) > 0), [value], [], [0.5]).select(F.col("q")[0].alias("_median"))
    whole = df.crossJoin(F.broadcast(positive)) if not positive.isEmpty() else df.withColumn("_median", F.lit(None).cast("double"))
    return whole.withColumn("tier", F.when(F.col(value) <= 0, "none").when(F.col(value) <= F.col("_median"), "low").when(F.col(value).isNotNull(), "high")).drop("_median")


def kernel_density(df: DataFrame, value: str, group: list[str], low: float, high: float, points: int, width: float) -> DataFrame:
    """Gaussian density of each group at evenly spaced points; every row meets only the fixed points."""
    step = (high - low) / (points - 1)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(low) + k * step)).alias("at")
    z = (F.col("at") - F.col(value)) / width
    spread = df.select(*group, value, at)
    return spread.groupBy(*group, "at").agg((F.sum(F.exp(-z * z / 2)) / (F.count(F.lit(1)) * width * F.sqrt(2 * F.pi()))).alias("density"))


def class_profile(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """Per group and column: n, median, quartiles, and the median's distance from the whole table's mean in its sample deviations."""
    found = ranking.quantiles(df, columns, group, [0.25, 0.5, 0.75])
    whole = ranking.long_form(df, columns, []).groupBy("column").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd"))
    q = F.col("q")
    return found.join(F.broadcast(whole), "column").select(*group, "column", "n", q[1].alias("median"), q[0].alias("q25"), q[2].alias("q75"), F.try_divide(q[1] - F.col("_mean"), F.col("_sd")).alias("standardized_median"))


def log_bin_profile(df: DataFrame, value: str, group: list[str], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    found = ranking.quantiles(df, [value], group, list(quantiles))
    return found.select(*group, "n", *[F.col("q")[k].alias(f"q{round(100 * x)}") for k, x in enumerate(quantiles)])
