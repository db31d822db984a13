"""Inference as column expressions; tails of t, F and Poisson by incomplete beta and gamma functions, on the few rows of a report."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The bounds of the Wilson interval; (0, 0) for n = 0."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = k / m
    d = 1 + z * z / m
    middle = (p + z * z / (2 * m)) / d
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    return F.coalesce(middle - half, F.lit(0.0)), F.coalesce(middle + half, F.lit(0.0))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    pooled = (k1 + k2) / (n1 + n2)
    return (k1 / n1 - k2 / n2) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))


def alpha_se(k1: Column, n1: Column, k0: Column, n0: Column) -> tuple[Column, Column]:
    """The difference of two proportions and its binomial standard error."""
    p1, p0 = k1 / n1, k0 / n0
    return p1 - p0, F.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)


def upper_limit(k: Column, n: Column) -> Column:
    """The share that is ruled out at 95 % where nothing was found in n: the rule of three; null where something was."""
    return F.when((k == 0) & (n > 0), F.least(3 / n, F.lit(1.0)))


def lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: its series below a + 1, else its continued fraction from the tail."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, front * total)
    value = 0.0
    for m in range(200 + int(10 * math.sqrt(a)), 0, -1):
        value = m * (m - a) / (x + 2 * m + 1 - a - value)
    return max(0.0, 1 - front / (x + 1 - a - value))


def poisson_upper(x: int, mu: float) -> float:
    """P(X >= x) for whole x: 1 for x = 0."""
    return 1.0 if x <= 0 else lower_gamma(x, mu)


def poisson_tail(x: Column, mu: Column) -> Column:
    return column_of(poisson_upper, x, mu)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction evaluated from the tail."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    value = 0.0
    for m in range(400, 0, -1):
        half, odd = divmod(m, 2)
        if odd:
            d = -(a + half) * (a + b + half) * x / ((a + m - 1) * (a + m))
        else:
            d = half * (b - half) * x / ((a + m - 1) * (a + m))
        value = d / (1 + value)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front / a / (1 + value)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def column_of(f: Callable[..., float], *columns: Column) -> Column:
    """``f`` of the columns, batch by batch; null where one of them is."""

    def run(*arrays: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in arrays), strict=True)
        return pa.array([None if None in r else f(*r) for r in rows], pa.float64())

    run.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(*columns)


def correlation(df: DataFrame, x: str, y: str, lost: int = 2) -> DataFrame:
    """n, r, t and the two-sided p of a correlation; ``lost`` degrees of freedom are taken off n."""
    out = df.agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    dof = (F.col("n") - lost).cast("double")
    out = out.withColumn("t", F.when(F.abs("r") < 1, F.col("r") * F.sqrt(dof / (1 - F.col("r") * F.col("r")))))
    return out.withColumn("p", column_of(t_two_sided, F.col("t"), dof))


def residuals(df: DataFrame, x: str, *ys: str) -> DataFrame:
    """``df`` (a row per period) with r_y, what a straight line in x leaves of each y."""
    fits = df.agg(*[f(F.col(y), F.col(x)).alias(f"{p}_{y}") for y in ys for f, p in ((F.regr_slope, "s"), (F.regr_intercept, "i"))])
    out = df.join(F.broadcast(fits))
    for y in ys:
        out = out.withColumn(f"r_{y}", F.col(y) - F.col(f"i_{y}") - F.col(f"s_{y}") * F.col(x))
    return out.drop(*[f"{p}_{y}" for y in ys for p in "si"])


def step_test(series: DataFrame, x: str, y: str, at: float) -> DataFrame:
    """Least squares with a line and a step at ``at`` against the line alone: step, RSS of both, F, its p and n."""
    r = residuals(series.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(x) >= at).cast("double").alias("s")), "x", "y", "s")
    out = r.agg(F.count("*").alias("n"), F.sum(F.col("r_y") * F.col("r_s")).alias("ys"), F.sum(F.col("r_s") * F.col("r_s")).alias("ss"), F.sum(F.col("r_y") * F.col("r_y")).alias("rss_line"))
    out = out.withColumn("step", F.col("ys") / F.col("ss")).withColumn("rss_step", F.col("rss_line") - F.col("ys") * F.col("ys") / F.col("ss"))
    out = out.select("n", "step", "rss_line", "rss_step", ((F.col("rss_line") - F.col("rss_step")) / (F.col("rss_step") / (F.col("n") - 3))).alias("f"))
    return out.withColumn("p", column_of(f_upper, F.col("f"), F.lit(1.0), (F.col("n") - 3).cast("double")))


def differences(series: DataFrame, order: str, *ys: str) -> DataFrame:
    w = Window.orderBy(order)  # a row per period
    return series.select(order, *[(F.col(y) - F.lag(y).over(w)).alias(y) for y in ys])
