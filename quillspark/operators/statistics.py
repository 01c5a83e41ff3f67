"""Tests, trends and intervals over paired scores."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.sources.scratch import written


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def _p_values(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else student_p(x, n) for x, n in zip(t, df, strict=True)])


def paired_ttest(rows: DataFrame, before: str, after: str) -> DataFrame:
    """One row: n, means, mean difference, t, Cohen's d (sample deviation), p and its flags. Under two pairs, or
    without spread, the test is NULL."""
    diff = F.col(before) - F.col(after)
    one = rows.agg(F.count(diff).alias("n"), F.avg(before).alias("mean_before"), F.avg(after).alias("mean_after"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd"))
    d = F.try_divide("mean_diff", F.nullif("sd", F.lit(0.0)))
    one = one.withColumn("cohens_d", d).withColumn("t", F.col("cohens_d") * F.sqrt("n"))
    one = one.withColumn("p", _p_values("t", (F.col("n") - 1).cast("double")))
    return one.withColumns({"significant_05": F.col("p") < 0.05, "significant_01": F.col("p") < 0.01}).drop("sd")


def linear_trend(rows: DataFrame, x: Column, y: Column, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def quadratic_trend(rows: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """``a x^2 + b x + c`` by least squares, from power sums of centred ``x``. Rows are made once: their count and sum of
    ``y`` for each ``x`` are written, and the mean and the power sums are taken from these."""
    made = written(rows.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"), F.sum(y).alias("_y")), "trend")
    centre = made.groupBy(*by).agg((F.sum(F.col(x) * F.col("_n")) / F.sum("_n")).alias("mid"))
    u = F.col(x) - F.col("mid")
    sums = {f"s{k}": F.sum(F.col("_n") * F.pow(u, F.lit(k))) for k in range(5)} | {f"t{k}": F.sum(F.col("_y") * F.pow(u, F.lit(k))) for k in range(3)}
    s = made.join(centre, list(by)).groupBy(*by, "mid").agg(*(e.alias(n) for n, e in sums.items()))  # one row per group
    det = "(s4*(s2*s0-s1*s1) - s3*(s3*s0-s1*s2) + s2*(s3*s1-s2*s2))"
    a = f"(t2*(s2*s0-s1*s1) - s3*(t1*s0-s1*t0) + s2*(t1*s1-s2*t0)) / nullif({det}, 0)"
    b = f"(s4*(t1*s0-s1*t0) - t2*(s3*s0-s1*s2) + s2*(s3*t0-t1*s2)) / nullif({det}, 0)"
    c = f"(s4*(s2*t0-t1*s1) - s3*(s3*t0-t1*s2) + t2*(s3*s1-s2*s2)) / nullif({det}, 0)"
    fit = s.selectExpr(*by, "mid", f"{a} AS a", f"{b} AS b1", f"{c} AS c1", "cast(s0 as bigint) AS n")
    return fit.selectExpr(*by, "a", "b1 - 2*a*mid AS b", "c1 - b1*mid + a*mid*mid AS c", "n")


def histogram(rows: DataFrame, value: str, edges: int = 30) -> DataFrame:
    """Counts in equal bins between ``edges`` edges from the least value less 1 to the greatest plus 1."""
    rows = written(rows.groupBy(value).agg(F.count("*").alias("_n")), "histogram")  # the rows are made once
    bounds = rows.agg((F.min(value) - 1).alias("lo"), (F.max(value) + 1).alias("hi"))  # one row
    bins = edges - 1
    at = F.least(F.lit(bins), F.width_bucket(F.col(value), F.col("lo"), F.col("hi"), F.lit(bins)))
    width = (F.col("hi") - F.col("lo")) / bins
    found = rows.crossJoin(F.broadcast(bounds)).groupBy(at.alias("bin"), (F.col("lo") + (at - 1) * width).alias("from"), (F.col("lo") + at * width).alias("to"))
    return found.agg(F.sum("_n").alias("n"))


def best_and_worst(rows: DataFrame, value: str, key: str) -> DataFrame:
    """Two rows: where ``value`` is greatest and least, the least key on ties."""
    least = lambda v: F.min_by(F.struct(key, value), F.struct(v.alias("v"), F.col(key).alias("k")))
    both = rows.agg(least(-F.col(value)).alias("best"), least(F.col(value)).alias("worst"))  # one row: the rows are made once
    return both.select(F.inline(F.array(*(F.struct(F.lit(w).alias("which"), F.col(f"{w}.{key}").alias(key), F.col(f"{w}.{value}").alias(value)) for w in ("best", "worst")))))
