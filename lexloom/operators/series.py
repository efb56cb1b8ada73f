"""Time series: daily aggregates, rolling means, interrupted series by least squares, robust errors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def daily(rows: DataFrame, ts: str, value: str, flag: Column) -> DataFrame:
    day = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("hits"), F.avg(value).alias("mean_value"))
    return day.withColumn("rate", F.col("hits") / F.greatest("n", F.lit(1)))


def rolling_mean(series: DataFrame, order: str, value: str, w: int, least: int) -> DataFrame:
    """Centered mean over ``2 * w + 1`` rows, null with fewer than ``least``. The series is one row per period."""
    frame = Window.orderBy(order).rowsBetween(-w, w)
    return series.withColumn("rolling", F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame)))


def its(series: DataFrame, day: str, value: str, cutoff: str) -> DataFrame:
    """Intercept, slope before, level shift and slope change of an interrupted series.

    The model is saturated on either side of the cutoff, so two simple regressions give its least-squares solution.
    Fewer than two distinct days on a side give nulls.
    """
    first = series.agg(F.min(day).alias("d0"))
    rows = series.crossJoin(F.broadcast(first)).select(F.datediff(day, "d0").cast("double").alias("t"), F.datediff(F.lit(cutoff).cast("date"), "d0").cast("double").alias("tc"), (F.col(day) >= F.lit(cutoff).cast("date")).alias("post"), F.col(value).alias("y"))

    def side(post: bool, what: str) -> Column:
        keep = F.col("post") if post else ~F.col("post")
        x, y = F.when(keep, F.col("t")), F.when(keep, F.col("y"))
        return {"slope": F.regr_slope(y, x), "intercept": F.regr_intercept(y, x)}[what]

    c = rows.agg(side(False, "intercept").alias("intercept"), side(False, "slope").alias("pre_slope"), side(True, "intercept").alias("i2"), side(True, "slope").alias("s2"), F.max("tc").alias("tc"), F.count(F.lit(1)).alias("n_days"))
    shift = F.col("i2") + F.col("s2") * F.col("tc") - (F.col("intercept") + F.col("pre_slope") * F.col("tc"))
    return c.select("n_days", "tc", "intercept", "pre_slope", shift.alias("level_shift"), (F.col("s2") - F.col("pre_slope")).alias("slope_change"))


def fitted(series: DataFrame, day: str, value: str, cutoff: str) -> DataFrame:
    """The fitted line at every day; the time after the cutoff is clipped at zero."""
    c = its(series, day, value, cutoff)
    first = series.agg(F.min(day).alias("d0"))
    rows = series.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(c))  # one row each
    t = F.datediff(day, "d0").cast("double")
    after = F.greatest(t - F.col("tc"), F.lit(0.0))
    post = (t >= F.col("tc")).cast("double")
    return rows.select(day, value, (F.col("intercept") + F.col("pre_slope") * t + F.col("level_shift") * post + F.col("slope_change") * after).alias("fitted"))


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / max(1 + num * d, 1e-300) if 1 + num * d > 0 else 1 / min(1 + num * d, -1e-300)
        c = 1 + num / c
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: int) -> float:
    return _beta_inc(df / 2, 0.5, df / (df + t * t))


def hac(spark: SparkSession, series: DataFrame, day: str, value: str, cutoff: str, lag: int = 7, max_days: int = 100_000) -> DataFrame:
    """Estimates of the interrupted series with Newey-West errors (Bartlett weights). The series has one row a day; its length is checked."""
    rows = series.select(day, value).where(F.col(value).isNotNull()).orderBy(day).limit(max_days + 1).collect()
    if len(rows) > max_days:
        raise ValueError(f"more than {max_days} days")
    if len(rows) < 10:
        return spark.createDataFrame([], "parameter string, estimate double, newey_west_se double, ci_95_low double, ci_95_high double, p_value double")
    d0 = rows[0][0]
    t = np.array([(r[0] - d0).days for r in rows], dtype=float)
    y = np.array([float(r[1]) for r in rows])
    import datetime

    tc = (datetime.date.fromisoformat(cutoff) - d0).days
    post = (t >= tc).astype(float)
    x = np.column_stack((np.ones_like(t), t, post, post * (t - tc)))
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    u = x * (y - x @ beta)[:, None]
    meat = u.T @ u
    for k in range(1, min(lag, len(t) - 1) + 1):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / (lag + 1)) * (g + g.T)
    se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
    out = []
    for name, b, s in zip(("intercept", "pre_slope", "level_shift", "slope_change"), beta.tolist(), se.tolist(), strict=True):
        out.append((name, b, s, b - 1.96 * s, b + 1.96 * s, t_two_sided(b / s, len(t) - 4) if s else None))
    return spark.createDataFrame(out, "parameter string, estimate double, newey_west_se double, ci_95_low double, ci_95_high double, p_value double")


def islands(rows: DataFrame, part: Sequence[str], order: str, label: str) -> DataFrame:
    """Consecutive rows with the same label as one: first and last place and length."""
    w = Window.partitionBy(*part).orderBy(order)
    change = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    marked = rows.withColumn("_c", change).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*part, "island", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
