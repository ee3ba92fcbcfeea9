"""Ordered running totals that never sort one whole group in one task.

A window partitioned by a hot key sends the whole key to one task. Here the key is cut into blocks that
follow the order; each block is scanned on its own, and only the per-block totals are scanned per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"


def block_offsets(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Per (keys, block): total of ``value`` over all earlier blocks of the same keys."""
    totals = df.groupBy(*keys, BLOCK).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, BLOCK, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))


def running_total(df: DataFrame, keys: list[str], block: Column, order: list, value: Column,
                  out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per keys in ``order``. ``block`` must not decrease along ``order``."""
    blocked = df.withColumn(BLOCK, block)
    inside = (Window.partitionBy(*keys, BLOCK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = block_offsets(blocked, keys, value)
    return (blocked.withColumn(out, F.sum(value).over(inside))
            .join(offsets, [*keys, BLOCK])
            .withColumn(out, F.col(out) + F.col("__before"))
            .drop(BLOCK, "__before"))


#: Rows of a key up to which one scan per key takes less than the blocks' three shuffles.
SHORT = 1 << 18


def position(df: DataFrame, keys: list[str], block: Column, order: list, out: str, longest: int | None = None) -> DataFrame:
    """1-based dense position of each row per keys in ``order`` (row_number without the hot window). ``longest``: rows of the most
    frequent keys, if known; where they are few no blocks are needed. Rows without a key are left out."""
    if longest is not None and longest <= SHORT:
        return df.dropna(subset=keys).withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return running_total(df, keys, block, order, F.lit(1), out)
