"""Reporting aggregations: the tables behind the figures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.exprs import finite
from gatelens.functions.gram import pair_moments
from gatelens.functions.joins import join_small
from gatelens.functions.quantiles import exact_quantiles
from gatelens.operators.sweep import KEY


def family_summary(frame: DataFrame) -> DataFrame:
    """Per family, hardest first. Distinct circuits are counted over pre-aggregated (family, file) rows."""
    per_file = frame.groupBy("true_family", "file").agg(
        *[F.sum(c).alias(f"s_{c}") for c in ("selected_threshold", "forward_wall_s", "max_cut_pressure")],
        *[F.count(c).alias(f"n_{c}") for c in ("selected_threshold", "forward_wall_s", "max_cut_pressure")],
        F.min("selected_threshold").alias("mn"), F.max("selected_threshold").alias("mx"))
    mean = lambda c: F.try_divide(F.sum(f"s_{c}"), F.sum(f"n_{c}"))
    return per_file.groupBy("true_family").agg(
        F.count("file").alias("n_circuits"), mean("selected_threshold").alias("mean_threshold"), F.min("mn").alias("min_threshold"),
        F.max("mx").alias("max_threshold"), mean("forward_wall_s").alias("mean_runtime"), mean("max_cut_pressure").alias("mean_max_cut_pressure"),
    ).orderBy(F.col("mean_threshold").desc(), "true_family")


def target_correlations(df: DataFrame, features: list[str], targets: list[str], k: int = 15) -> DataFrame:
    """(target, feature, abs_r): the k features of largest |r| per target, from one pass."""
    r = np.abs(pair_moments(df, features + targets).correlations())
    rows = [(t, f, float(r[i, len(features) + j])) for j, t in enumerate(targets) for i, f in enumerate(features) if not np.isnan(r[i, len(features) + j])]
    long = df.sparkSession.createDataFrame(rows, "target string, feature string, abs_r double")
    best = [long.where(F.col("target") == t).orderBy(F.col("abs_r").desc(), "feature").limit(k) for t in targets]
    out = best[0]
    for b in best[1:]:
        out = out.unionByName(b)
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share in percent) of the non-NULL values, commonest first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("value", "n", (F.col("n") * 100.0 / total).alias("share")).orderBy(F.col("n").desc(), "value")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """I4: (bin, lo, hi, n) of equal width over the finite range, empty bins included; the last bin is closed."""
    x = df.select(finite(column).alias("x")).where("x IS NOT NULL")
    lo, hi = x.agg(F.min("x")).scalar(), x.agg(F.max("x")).scalar()
    ends = x.select("x", lo.alias("mn"), hi.alias("mx"))
    same = F.col("mn") == F.col("mx")
    ends = ends.select("x", F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                       F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    slot = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    width = (F.col("hi") - F.col("lo")) / bins
    counts = ends.groupBy(slot.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    every = ends.groupBy("lo", "hi").agg(F.sequence(F.lit(0), F.lit(bins - 1)).alias("bin")).withColumn("bin", F.explode("bin"))
    return every.join(counts.select("bin", "n"), "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mean_curve(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean fidelity and wall seconds per keys and rung over points of ok runs noted ok that have a fidelity."""
    ok = (F.col("status") == "ok") & F.col("note").contains("ok") & F.col("fid").isNotNull()
    return points.where(ok).groupBy(*keys, "threshold").agg(
        F.avg("fid").alias("mean_fidelity"), F.avg("wall").alias("mean_wall"), F.count(F.lit(1)).alias("n"))


def timeouts_by_rung(points: DataFrame) -> DataFrame:
    """Total, timeouts and the rest per rung."""
    late = F.coalesce(F.lower("note").contains("timeout"), F.lit(False))
    return points.groupBy("threshold").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(late, 1)).alias("timeouts"),
                                           F.count(F.when(~late, 1)).alias("ok_count"))


def return_codes(points: DataFrame) -> DataFrame:
    """(returncode, n)."""
    return points.where("returncode IS NOT NULL").groupBy("returncode").agg(F.count(F.lit(1)).alias("n")).orderBy("returncode")


def notes(points: DataFrame) -> DataFrame:
    """(note, n) with NULL as (null)."""
    return points.groupBy(F.coalesce("note", F.lit("(null)")).alias("note")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "note")


def first_per_config(points: DataFrame, columns: list[str]) -> DataFrame:
    """I8: first non-NULL value of each column per configuration and rung, by recorded order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
    return points.groupBy(*KEY, "threshold").agg(*[first(c) for c in columns])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for a <= b by position over columns with any value; NULL where r is undefined. One Gram matrix, whatever the columns."""
    moments = pair_moments(df, columns)
    r = moments.correlations()
    any_value = moments.count.diagonal() > 0
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)
            if j >= i and any_value[i] and any_value[j]]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def box_summary(df: DataFrame, column: str, by: str) -> DataFrame:
    """Quartiles, whiskers (furthest points within 1.5 IQR) and outlier count per group."""
    data = df.select(F.col(by).alias("grp"), finite(column).alias(column)).where(f"grp IS NOT NULL AND {column} IS NOT NULL")
    q = exact_quantiles(data, ["grp"], [column], [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("q")))
    quart = q.groupBy("grp").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    x, iqr = F.col(column), F.col("q3") - F.col("q1")
    inside = (x >= F.col("q1") - 1.5 * iqr) & (x <= F.col("q3") + 1.5 * iqr)
    return join_small(data, quart, ["grp"]).groupBy("grp", "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_outliers"), F.count(F.lit(1)).alias("n"))


def results_per_circuit(circuits: DataFrame, results: DataFrame) -> DataFrame:
    """Circuits with their number of results, most first."""
    counts = results.groupBy("file").agg(F.count(F.lit(1)).alias("n_results"))
    return circuits.join(counts, "file", "left").na.fill(0, ["n_results"]).orderBy(F.col("n_results").desc(), "file")


def long_sweep(points: DataFrame, circuits: DataFrame) -> DataFrame:
    """Every sweep point with its circuit's family and size."""
    return points.join(circuits.select("file", "family", "n_qubits"), "file", "left")


def scatter_sample(df: DataFrame, family: str, order: str, n: int) -> DataFrame:
    """The rows of the first ``n`` families by first appearance; the chosen families are at most ``n`` rows."""
    chosen = df.where(F.col(family).isNotNull()).groupBy(family).agg(F.min(order).alias("first")).orderBy("first", family).limit(n)
    return df.join(F.broadcast(chosen.select(family)), family, "left_semi")


def size_bucket(n_qubits: Column) -> Column:
    """Small up to 20, medium 21 to 60, large from 100; 61 to 99 is undefined."""
    return (F.when(n_qubits <= 20, "small").when(n_qubits.between(21, 60), "medium").when(n_qubits >= 100, "large"))
