"""The feature frame: joins, flags, targets, column choice, imputation.

Statistics that decide about columns (spread, medians) are one value per column; they come to the driver as a single
row and go back as literals, so applying them is a plain projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.constants import NOT_A_FEATURE, RUNGS_SCORING
from gatelens.functions.exprs import d, finite, rung_log2
from gatelens.functions.quantiles import exact_quantiles

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def attach_circuit_features(results: DataFrame, features: DataFrame) -> DataFrame:
    """H1: results with the features of their circuit. The planner broadcasts the feature side only if it is small."""
    return results.join(features, "file", "left")


def config_flags(df: DataFrame) -> DataFrame:
    """H2: is_gpu and is_double as 0/1."""
    return df.withColumns({"is_gpu": F.coalesce(F.col("backend") == "GPU", F.lit(False)).cast("double"),
                           "is_double": F.coalesce(F.col("precision") == "double", F.lit(False)).cast("double")})


def log_targets(df: DataFrame) -> DataFrame:
    """H3: log1p of the runtime columns that exist, NULL as 0."""
    names = {"forward_wall_s": "log_forward_wall_s", "estimated_setup_s": "log_setup_s", "estimated_per_shot_s": "log_per_shot_s"}
    return df.withColumns({new: F.log1p(F.coalesce(d(F.col(old)), F.lit(0.0))) for old, new in names.items() if old in df.columns})


def holdout_frame(tasks: DataFrame, id_map: DataFrame, features: DataFrame, allow_missing_ids: bool = False) -> DataFrame:
    """H4: one row per task with the features of its circuit.

    A task without a map entry fails the job (or is skipped), a circuit without features always fails it.
    """
    found = tasks.join(id_map.select(F.col("id").alias("task_id"), "qasm_file"), "task_id", "inner" if allow_missing_ids else "left")
    missing_id = F.raise_error(F.concat(F.lit("task id missing from id map: "), F.col("task_id").cast("string"))).cast("string")
    named = found.withColumn("file", F.coalesce("qasm_file", missing_id)).drop("qasm_file")
    joined = named.join(features.withColumn("__known", F.lit(True)), "file", "left")
    missing_file = F.raise_error(F.concat(F.lit("missing circuit: "), F.col("file").cast("string"))).cast("boolean")
    return (joined.where(F.coalesce("__known", missing_file)).drop("__known").withColumnRenamed("processor", "backend"))


def feature_columns(names: list[str]) -> list[str]:
    """H5: names without any label or metadata pattern; sweep columns are never features."""
    return [c for c in names if not c.startswith("sweep_") and not any(p in c for p in NOT_A_FEATURE)]


def column_spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, std): filled count and sample std of each numeric column, from one pass."""
    types = dict(df.dtypes)
    numeric = [c for c in columns if types[c] in NUMERIC]
    one = df.agg(*[F.struct(F.count(c).alias("n"), F.stddev_samp(d(F.col(c))).alias("std")).alias(c) for c in numeric])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.std").alias("std")) for c in numeric])
    return one.select(F.explode(cells).alias("s")).select("s.*")


def varying_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """H6: columns with any value and a sample std above 1e-10, in the given order."""
    keep = {r.feature for r in column_spread(df, columns).where("n > 0 AND std > 1e-10").collect()}
    return [c for c in columns if c in keep]


def drop_constant(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *varying_columns(df, columns))


def align_columns(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """H7: exactly the stored columns in stored order, then the two flags if they are not among them."""
    flags = config_flags(df)
    types = dict(flags.dtypes)

    def column(c: str) -> Column:
        if c not in types:
            return F.lit(0.0).alias(c)
        return (d(F.col(c)) if types[c] in NUMERIC else F.col(c).cast("string").try_cast("double")).alias(c)

    wanted = columns + [f for f in ("is_gpu", "is_double") if f not in columns]
    return flags.select(*(keep or []), *[column(c) for c in wanted])


def fit_fill(df: DataFrame, columns: list[str], how: str = "median") -> dict[str, float]:
    """H8: exact median or mean of the finite values of each column; columns without any are left out."""
    if how == "median":
        return {r.feature: r.q for r in exact_quantiles(df, [], columns, [0.5]).collect()}
    row = df.agg(*[F.avg(finite(c)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    """H8: NaN and infinities become NULL, NULL becomes the fitted value."""
    return df.withColumns({c: F.coalesce(finite(c), F.lit(v)) for c, v in fill.items()})


def labelled_only(df: DataFrame) -> DataFrame:
    """H9: rows with both labels."""
    return df.where(F.col("selected_threshold").isNotNull() & F.col("forward_wall_s").isNotNull())


def targets(df: DataFrame, key: str = "id") -> DataFrame:
    """H9: the four targets as DOUBLE."""
    return df.select(key, *[d(F.col(c)).alias(c) for c in ("selected_threshold", "forward_wall_s", "estimated_setup_s", "estimated_per_shot_s")])


def expand_rungs(df: DataFrame, curve_columns: dict[int, str], keep: list[str]) -> DataFrame:
    """One row per row and rung with a finite target: keep..., rung, log2_rung, y."""
    cells = F.array(*[F.struct(F.lit(r).alias("rung"), finite(c).alias("y")) for r, c in curve_columns.items()])
    out = df.select(*keep, F.explode(cells).alias("p")).where("p.y IS NOT NULL")
    return out.select(*keep, "p.rung", rung_log2(F.col("p.rung")).alias("log2_rung"), "p.y")


def threshold_feature(df: DataFrame, column: str, mode: str = "log2") -> DataFrame:
    """Adds thr_log2, thr_raw or both."""
    new = {}
    if mode in ("log2", "both"):
        new["thr_log2"] = rung_log2(F.col(column))
    if mode in ("raw", "both"):
        new["thr_raw"] = d(F.col(column))
    return df.withColumns(new)


def with_extras(selected: list[str], available: list[str]) -> list[str]:
    """The selected names, then the flags that are available and not yet among them."""
    return selected + [f for f in ("is_gpu", "is_double") if f in available and f not in selected]


CURVE_COLUMNS = {r: f"sweep_fid_{r}" for r in RUNGS_SCORING}
