"""Joins of many rows with few, where one key may hold a third of the many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUND = 4096
SALT = "__salt"


def join_salted(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 8, how: str = "inner") -> DataFrame:
    """Equi-join in which a key's rows of ``big`` are dealt over ``salts`` tasks and ``small`` is copied to each."""
    dealt = big.withColumn(SALT, F.pmod(F.xxhash64(*[c for c in big.columns if c not in keys] or keys), F.lit(salts)).cast("int"))
    copied = small.withColumn(SALT, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return dealt.join(copied, [*keys, SALT], how).drop(SALT)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], bound: int = BOUND, how: str = "inner") -> DataFrame:
    """Equi-join without a shuffle of ``big`` if ``small`` has at most ``bound`` rows, which is checked; else salted."""
    rows = small.limit(bound + 1).collect()
    if len(rows) > bound:
        return join_salted(big, small, keys, how=how)
    return big.join(F.broadcast(big.sparkSession.createDataFrame(rows, small.schema)), keys, how)


def gather(parts: list[DataFrame], key: str) -> DataFrame:
    """Inner join of many tables of numbers with one row per key: their rows meet in one shuffle and one grouping, so a task holds
    one sort, not one for each table, and nothing is broadcast. All columns but the key become DOUBLE."""
    rows = [p.select(key, F.lit(i).alias("part"), F.array(*[F.col(c).cast("double") for c in p.columns if c != key]).alias("x")) for i, p in enumerate(parts)]
    met = reduce(DataFrame.unionByName, rows).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", "x"))).alias("all"))
    named = [F.col("all")[i]["x"][j].alias(c) for i, p in enumerate(parts) for j, c in enumerate(c for c in p.columns if c != key)]
    return met.where(F.size("all") == len(parts)).select(key, *named)
