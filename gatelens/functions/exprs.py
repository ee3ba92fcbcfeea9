"""Small column expressions used by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def d(value) -> Column:
    """Literal or column as DOUBLE."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("double")


def finite(c) -> Column:
    """NaN and infinities become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def entropy_from(weights: Column, total: Column) -> Column:
    """Aggregate: log2 entropy of the positive weights, where ``total`` is their known sum.

    -sum(w/T * log2(w/T)) = log2(T) - sum(w * log2 w) / T, so no second pass is needed.
    """
    wlog = F.sum(F.when(weights > 0, weights * F.log2(weights)).otherwise(0.0))
    return F.when(total > 0, F.log2(total) - wlog / total).otherwise(0.0)


def rung_log2(threshold: Column, top: int = 512) -> Column:
    """log2 of a threshold clipped to the ladder."""
    return F.log2(F.least(F.greatest(threshold.cast("double"), F.lit(1.0)), F.lit(float(top))))


def half_even(c: Column, places: int = 0) -> Column:
    return F.bround(c, places)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r over the pairs without NULL; NULL when either side does not vary.

    Built from the covariance because ``corr`` divides by zero on constant input under ANSI rules.
    """
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))
