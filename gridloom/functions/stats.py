"""Statistics that agree with the usual array libraries: nulls are skipped, degenerate cases are gated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def nan_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """Clip to [lo, hi]; a null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c with one rounding: the product's and the sum's errors are found exactly and added to the rounded sum."""
    big = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # upper half of the digits
    p = a * b
    a1, b1 = big(a), big(b)
    a2, b2 = a - a1, b - b1
    s = p + c
    lost = (p - (s - (s - p))) + (c - (s - p)) + (((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2)
    return F.when(finite(s + lost), s + lost).otherwise(s)


def quantile(x: Column, q: float) -> Column:
    """Linear-interpolation quantile, exact."""
    return F.percentile(x, F.lit(q))


def correlation(x: Column, y: Column) -> Column:
    """Pearson over rows where both are present; null where either is constant (the built-in one divides by zero)."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


#: A correlation this near zero counts as zero: whether it is above or below is the rounding of the sums, which changes with their order.
NO_CORRELATION = 1e-12


def orientation_all(x: Column, y: Column, min_rows: int = 10, fallback: int = 1) -> Column:
    """1 if the correlation is not negative, else -1; an undefined one is -1; few rows give ``fallback``."""
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    return F.when(both < min_rows, F.lit(fallback)).otherwise(F.when(F.coalesce(correlation(x, y), F.lit(-1.0)) >= -NO_CORRELATION, 1).otherwise(-1))


def orientation_negative(x: Column, y: Column, min_rows: int = 20, fallback: int = 1) -> Column:
    """-1 if the correlation is negative, else 1; an undefined one is 1; few rows give ``fallback``."""
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    return F.when(both < min_rows, F.lit(fallback)).otherwise(F.when(F.coalesce(correlation(x, y), F.lit(1.0)) < -NO_CORRELATION, -1).otherwise(1))


def slope_intercept(y: Column, x: Column) -> tuple[Column, Column]:
    return F.regr_slope(y, x), F.regr_intercept(y, x)


def calibration_plain(y: Column, x: Column) -> tuple[Column, Column]:
    """y ~ a x + b over all rows; the identity for fewer than two rows or a nearly constant x."""
    a, b = slope_intercept(y, x)
    ok = (F.count(F.lit(1)) >= 2) & (F.coalesce(F.stddev_pop(x), F.lit(0.0)) >= 1e-6)
    return F.when(ok, a).otherwise(F.lit(1.0)), F.when(ok, b).otherwise(F.lit(0.0))


def error_metrics(y: Column, p: Column) -> dict[str, Column]:
    """MAE, RMSE and SMAPE in percent, where 0 / 0 counts as 0."""
    e, d = F.abs(y - p), F.abs(y) + F.abs(p)
    return {
        "mae": F.avg(e),
        "rmse": F.sqrt(F.avg(e * e)),
        "smape": F.avg(F.when(d == 0, F.lit(0.0)).otherwise(2 * e / d)) * 100,
    }
