"""Tail probabilities as Column arithmetic: incomplete beta and gamma functions by continued fractions and series.

Folds run a fixed number of steps, enough for 1e-10 in the ranges they are used in.  One row has one statistic, so their cost is small.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-300
STEPS = 400
#: Degrees of freedom from which t goes through its normal transform, whose error is far below 1e-10 there.
MANY = 20_000
#: The larger sample up to which two samples are compared by counting paths.
PATHS = 10_000


def log_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0: Stirling's series at x + 10, less the logarithms of the ten factors between."""
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))
    product = x
    for k in range(1, 10):
        product = product * (x + k)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _fraction(first: Column, step) -> Column:
    """Lentz's evaluation of a continued fraction 1/(1 + ...): step(k, acc) gives the k-th numerators and denominators in turn."""
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda acc, k: step(k.cast("double"), acc))["h"]


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """The regularised I_x(a, b), 0 <= x <= 1."""

    def tail(x: Column, a: Column, b: Column) -> Column:
        def step(k: Column, acc: Column) -> Column:
            for n in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
                d = 1 / _away(1 + n * acc["d"])
                c = _away(1 + n / acc["c"])
                acc = F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))
            return acc

        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(_away(x)) + b * F.ln(_away(1 - x))) / a
        return front * _fraction(1 / _away(1 - (a + b) * x / (a + 1)), step)

    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), tail(x, a, b)).otherwise(1 - tail(1 - x, b, a))


def upper_gamma(a: Column, x: Column) -> Column:
    """The regularised Q(a, x): a series below a + 1, a continued fraction above."""
    front = F.exp(a * F.ln(_away(x)) - x - log_gamma(a))
    term = lambda acc, k: F.struct((acc["t"] * x / (a + k)).alias("t"), (acc["s"] + acc["t"] * x / (a + k)).alias("s"))
    below = 1 - front * F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct((1 / a).alias("t"), (1 / a).alias("s")), term)["s"]

    def step(k: Column, acc: Column) -> Column:
        n = -k * (k - a)
        base = x + 2 * k + 1 - a
        d = 1 / _away(n * acc["d"] + base)
        c = _away(base + n / acc["c"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"))

    start = F.struct(F.lit(1 / TINY).alias("c"), (1 / _away(x + 1 - a)).alias("d"), (1 / _away(x + 1 - a)).alias("h"))
    above = front * F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda acc, k: step(k.cast("double"), acc))["h"]
    return F.when(x <= 0, 1.0).when(x < a + 1, below).otherwise(above)


def normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal."""
    return upper_gamma(F.lit(0.5), z * z / 2)


def student_tail(t: Column, freedom: Column) -> Column:
    """P(|T| > |t|) of Student's t; null without degrees of freedom, 0 for an infinite t.

    With very many degrees of freedom t is turned into a normal deviate (Hill's transform), as the fraction would need more steps than it has.
    """
    v = freedom.cast("double")
    exact = incomplete_beta(v / (v + t * t), v / 2, F.lit(0.5))
    a = v - 0.5
    b = 48 * a * a
    y = a * F.log1p(t * t / v)
    z = (((((-0.4 * y - 3.3) * y - 24) * y - 85.5) / (0.8 * y * y + 100 + b) + y + 3) / b + 1) * F.sqrt(y)
    return F.when(v > 0, F.when(F.abs(t) == math.inf, 0.0).when(v > MANY, normal_tail(z)).otherwise(exact))


def chi_square_tail(x: Column, freedom: Column) -> Column:
    return F.when(freedom > 0, upper_gamma(freedom.cast("double") / 2, x / 2))


def paths_outside(d: float, m: int, n: int) -> float:
    """P(D >= d) for samples of m and n without ties: one less the share of orders of both samples whose two distributions stay nearer than d.

    Orders are counted by length: the one element more is the first sample's i-th of s with probability i / s.
    """
    inside = np.zeros(m + 2)
    inside[1] = 1.0
    i = np.arange(m + 1)
    limit = round(d * m * n)  # d is a multiple of 1 / (m n)
    for s in range(1, m + n + 1):
        j = s - i
        inside[1:] = np.where((j >= 0) & (j <= n) & (np.abs(i * n - j * m) < limit), inside[:-1] * i / s + inside[1:] * j / s, 0.0)
    return float(min(1.0, max(0.0, 1.0 - inside[m + 1])))


@F.pandas_udf(DoubleType())
def _exact_two_sample(d: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else paths_outside(float(x), int(a), int(b)) if x > 0 else 1.0 for x, a, b in zip(d, m, n, strict=True)], dtype="float64")


def two_sample_tail(d: Column, m: Column, n: Column) -> Column:
    """P(D >= d) of the two-sample statistic: exact where the larger sample has up to PATHS rows, else Kolmogorov's series with the usual
    correction of the root of the effective size."""
    root = F.sqrt(m * n / (m + n).cast("double"))
    x = (root + 0.12 + 0.11 / root) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    small = F.greatest(m, n) <= PATHS
    exact = _exact_two_sample(F.when(small, d), F.when(small, m), F.when(small, n))
    return F.when(small, exact).when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
