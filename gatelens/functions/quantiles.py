"""Exact linear-interpolated quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory. That is right where values are few
(spans, degrees, rungs), but not for measurements. Here a sketch of bounded size brackets each wanted rank, the
exact count below the bracket comes from a plain aggregation, and only the values inside the bracket (a fixed
small share of the group, pre-aggregated by value) are ordered, in blocks. A rank outside its bracket raises,
so the result is exact or an error. Keys must not be NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.functions.blocks import running_total
from gatelens.functions.joins import join_small

SKETCH_ACCURACY = 10_000
MARGIN = 4.0 / SKETCH_ACCURACY
VALUE_BLOCKS = 256


def long_values(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Unpivot to (keys, feature, x), dropping NULL, NaN and infinities."""
    cells = [F.struct(F.lit(v).alias("feature"), F.col(v).cast("double").alias("x")) for v in values]
    out = df.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.feature", "cell.x")
    return out.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))


def exact_quantiles(df: DataFrame, keys: list[str], values: list[str], probs: list[float]) -> DataFrame:
    """(keys, feature, prob, n, q): quantile ``prob`` of each value column per keys."""
    return quantiles_of_long(long_values(df, keys, values), [*keys, "feature"], probs)


def quantiles_of_long(data: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The same for data already in (keys, x) form."""
    m = len(probs)
    lows = [max(p - MARGIN, 0.0) for p in probs]
    highs = [min(p + MARGIN, 1.0) for p in probs]
    ends = F.percentile_approx("x", F.array(*[F.lit(p) for p in lows + highs]), F.lit(SKETCH_ACCURACY))
    stats = data.groupBy(*keys).agg(
        F.count("x").alias("n"), ends.alias("ends"), F.min("x").alias("mn"), F.max("x").alias("mx"))
    few = F.col("n") <= SKETCH_ACCURACY  # so few values that all of them are ordered
    brackets = F.array(*[
        F.struct(
            F.lit(float(p)).alias("prob"),
            (F.lit(float(p)) * (F.col("n") - 1)).alias("at"),
            F.when(few | F.lit(lows[i] == 0.0), F.col("mn")).otherwise(F.col("ends")[i]).alias("lo"),
            F.when(few | F.lit(highs[i] == 1.0), F.col("mx")).otherwise(F.col("ends")[m + i]).alias("hi"))
        for i, p in enumerate(probs)])
    # few groups reach the rows as a checked broadcast, many by salted keys: no group is ever one task
    groups = join_small(data, stats.select(*keys, "n", brackets.alias("brackets")), keys)

    # rows below a bracket become one counted NULL per group, rows above it are not needed
    group = [*keys, "prob", "n", "at", "lo", "hi"]
    counted = (groups.select(*keys, "n", "x", F.explode("brackets").alias("b"))
               .where(F.col("x") <= F.col("b.hi"))
               .select(*keys, "n", "b.*", F.when(F.col("x") >= F.col("b.lo"), F.col("x")).alias("x"))
               .groupBy(*group, "x").agg(F.count(F.lit(1)).alias("c")))
    width = F.col("hi") - F.col("lo")
    block = (F.when(F.col("x").isNull(), F.lit(-1))
             .when(width > 1e-200, F.floor(F.try_divide(F.col("x") - F.col("lo"), width) * VALUE_BLOCKS))
             .otherwise(F.lit(0)).cast("long"))
    ranked = running_total(counted, group, block, [F.col("x").asc_nulls_first()], F.col("c"), "upto")

    lower = F.floor("at")
    upper = F.least(lower + 1, F.col("n") - 1)
    entry = F.struct("x", (F.col("upto") - F.col("c")).alias("below"))
    picked = ranked.where(F.col("x").isNotNull()).groupBy(*group).agg(
        F.min(F.when(F.col("upto") > lower, entry)).alias("a"),
        F.min(F.when(F.col("upto") > upper, entry)).alias("z"))
    q = (F.when(F.col("z").isNotNull() & (F.col("a.below") <= lower),
                F.col("a.x") + (F.col("z.x") - F.col("a.x")) * (F.col("at") - lower))
         .otherwise(F.raise_error(F.lit("quantile rank left its bracket")).cast("double")))
    return picked.select(*keys, "prob", "n", q.alias("q"))


def one_row(quantiles: DataFrame, values: list[str], probs: list[float]) -> DataFrame:
    """Global quantiles as one row with an array column per value (in the order of ``probs``)."""
    return quantiles.agg(*[
        F.array(*[F.max(F.when((F.col("feature") == v) & (F.col("prob") == float(p)), F.col("q"))) for p in probs])
        .alias(v) for v in values])
