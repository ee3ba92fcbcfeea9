"""Decision layers on top of model output: all column expressions or one aggregation.

A probability column holds one value per rung index 0..8.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.constants import FAMILY_FLOOR, HARD_FAMILIES, RUNGS_SCORING, TARGET_FIDELITY
from gatelens.functions.exprs import d, finite, half_even

N = len(RUNGS_SCORING)


def pad_probabilities(p: Column, labels: list[int]) -> Column:
    """M2: probabilities of the given class labels as an array over all nine rungs, absent classes 0."""
    return F.array(*[p[labels.index(i)] if i in labels else F.lit(0.0) for i in range(N)])


def expected_scores(p: Column) -> Column:
    """ARRAY of the expected threshold score of answering each rung: sum over true j <= i of p[j] * 2^-(i-j)."""
    return F.array(*[reduce(lambda a, b: a + b, [p[j] * (2.0 ** (j - i)) for j in range(i + 1)]) for i in range(N)])


def first_max(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def decide(p: Column, policy: str = "expected_score") -> Column:
    """M3: rung index of the best expected score (or the likeliest rung), the first on ties."""
    return first_max(p if policy == "argmax" else expected_scores(p))


def safety_margin(idx: Column, margin: float = 0.0) -> Column:
    """M4: half-even rounded index plus margin, clipped, as a threshold."""
    moved = F.least(F.greatest(half_even(d(idx) + F.lit(float(margin))), F.lit(0.0)), F.lit(float(N - 1)))
    return F.pow(F.lit(2.0), moved).cast("int")


def expected_index(p: Column) -> Column:
    """M5."""
    return reduce(lambda a, b: a + b, [p[i] * float(i) for i in range(N)])


def entropy(p: Column) -> Column:
    """M5: -sum p ln(p + 1e-9)."""
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log(x + 1e-9))


def uncertainty(p: Column) -> Column:
    """M6."""
    return 1.0 - F.array_max(p)


def family_floor(pred: Column, family: Column) -> Column:
    """M7: at least the family's floor; families without one have floor 1."""
    floors = F.create_map(*[F.lit(x) for item in FAMILY_FLOOR.items() for x in item])
    return F.greatest(pred, F.coalesce(F.try_element_at(floors, family), F.lit(1)))


def curve_weights(points: DataFrame, key: list[str], rungs: list[int] = RUNGS_SCORING, target: float = TARGET_FIDELITY) -> DataFrame:
    """M9: adds ``weight`` to (key, rung, y); high near the target fidelity and near the crossing rung."""
    index = F.array_position(F.array(*[F.lit(r) for r in rungs]), F.col("rung")) - 1
    crossed = F.min(F.when(F.col("y") >= target, F.col("i"))).over(Window.partitionBy(*key))
    w = points.withColumn("i", index).withColumn("cross", F.coalesce(crossed, F.lit(len(rungs) - 1)))
    by_rung = 1.0 / (1.0 + F.abs(F.log2(d(F.col("rung")) / rungs[0])))
    by_fidelity = 1.0 + 2.0 * F.exp(-F.pow(F.col("y") - target, 2) / (2 * 0.08 ** 2))
    by_cross = 1.0 + 2.0 * F.exp(-F.pow(d(F.col("i") - F.col("cross")), 2) / 2.0)
    return w.withColumn("weight", by_rung * by_fidelity * by_cross).drop("i", "cross")


def monotone_curve(points: DataFrame, key: list[str]) -> DataFrame:
    """Y clipped to [0, 1] and made non-decreasing over the rungs of a key (at most ten)."""
    run = Window.partitionBy(*key).orderBy("rung").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clipped = F.least(F.greatest(F.col("y"), F.lit(0.0)), F.lit(1.0))
    return points.withColumn("y", F.max(clipped).over(run))


def curve_to_threshold(points: DataFrame, key: list[str], target: float = TARGET_FIDELITY) -> DataFrame:
    """First rung at target, else the last rung."""
    return points.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("y") >= target, F.col("rung"))), F.max("rung")).alias("threshold"))


def safe_expm1(x: Column, max_log: float = 12.0) -> Column:
    """expm1 with the exponent clipped to [-20, max_log] and NaN as 0."""
    x = F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    return F.expm1(F.least(F.greatest(x, F.lit(-20.0)), F.lit(max_log)))


def clip_runtime(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.1)), F.lit(10000.0))


def combine_heads(log_setup: Column, log_per_shot: Column, shots: int = 10000) -> Column:
    """Total seconds from the two log heads."""
    return safe_expm1(log_setup) + safe_expm1(log_per_shot) * shots


def runtime_decomposed(total: Column, log_setup: Column | None = None, log_per_shot: Column | None = None) -> tuple[Column, Column, Column]:
    """(setup, per_shot, total); without heads a tenth of the total is setup."""
    if log_setup is not None and log_per_shot is not None:
        setup, per_shot = safe_expm1(log_setup), safe_expm1(log_per_shot)
        return setup, per_shot, setup + per_shot * 10000
    return total * 0.1, (total - total * 0.1) / 10000, total


def blend_grid() -> list[tuple[float, float, float]]:
    """Six steps for the first weight, six for the second within the rest, the third takes what is left."""
    grid = []
    for i in range(6):
        base = i * 0.2
        for j in range(6):
            second = j * ((1.0 - base) / 5)
            rest = 1.0 - base - second
            if rest >= 0:
                grid.append((base, second, rest))
    return grid


def blend_scores(df: DataFrame, preds: list[str], truth: str) -> DataFrame:
    """(grid_no, w0, w1, w2, score) with score = -mean |ln(blend / truth)|, all weights in one pass."""
    floor = lambda c: F.greatest(c, F.lit(1e-6))
    grid = blend_grid()
    aggs = [F.avg(-F.abs(F.log(floor(sum((F.col(p) * w for p, w in zip(preds, ws)), F.lit(0.0))) / floor(F.col(truth))))).alias(f"s{i}")
            for i, ws in enumerate(grid)]
    cells = [F.struct(F.lit(i).alias("grid_no"), *[F.lit(w).alias(f"w{k}") for k, w in enumerate(ws)], F.col(f"s{i}").alias("score"))
             for i, ws in enumerate(grid)]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("g")).select("g.*")


def blend_search(df: DataFrame, preds: list[str], truth: str) -> DataFrame:
    """The grid row of the best score, the first on ties."""
    return blend_scores(df, preds, truth).orderBy(F.col("score").desc(), "grid_no").limit(1)


def log_calibration(df: DataFrame, pred: str, truth: str, min_rows: int = 5) -> DataFrame:
    """Least squares of log1p(truth) on log1p(pred) over valid rows; NULL below five rows or for constant pred."""
    p, t = finite(pred), finite(truth)
    valid = (p > 0) & (t > 0)
    x, y = F.when(valid, F.log1p(F.greatest(p, F.lit(1e-6)))), F.when(valid, F.log1p(F.greatest(t, F.lit(1e-6))))
    agg = df.agg(F.count(F.when(valid, 1)).alias("n"), F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    slope = F.when((F.col("n") >= min_rows) & (F.col("xx") > 0), F.try_divide("xy", "xx"))
    return agg.select("n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def apply_calibration(pred: Column, slope: float | None, intercept: float | None) -> Column:
    if slope is None:
        return pred
    return safe_expm1(F.lit(slope) * F.log1p(F.greatest(pred, F.lit(1e-6))) + F.lit(intercept))


# ------------------------------------------------------------------ auxiliary targets

AUXILIARY = ["fidelity_at_1", "rungs_to_099", "biggest_fid_jump", "biggest_jump_rung"]


def auxiliary_forward(name: str) -> Column:
    """Target in model space."""
    y = finite(name)
    if name == "fidelity_at_1":
        c = F.least(F.greatest(y, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(c / (1 - c))
    if name in ("rungs_to_099", "biggest_jump_rung"):
        return F.log2(F.least(F.greatest(y, F.lit(1.0)), F.lit(512.0)))
    return y


def auxiliary_inverse(name: str, pred: Column) -> Column:
    """Prediction back in target space."""
    if name == "fidelity_at_1":
        return 1.0 / (1.0 + F.exp(-pred))
    if name in ("rungs_to_099", "biggest_jump_rung"):
        return half_even(F.pow(F.lit(2.0), F.least(F.greatest(pred, F.lit(0.0)), F.lit(9.0))))
    return F.least(F.greatest(pred, F.lit(0.0)), F.lit(1.0))


def combined_threshold(direct: Column, curve: Column | None, family: Column) -> Column:
    """Hard families take the larger of direct and curve threshold; then the family floor."""
    out = direct if curve is None else F.when(family.isin(HARD_FAMILIES), F.greatest(direct, curve)).otherwise(direct)
    return family_floor(out, family)


def combined_runtime(direct: Column, curve: Column | None) -> Column:
    """Geometric mean with the runtime read off a curve, if there is one."""
    return direct if curve is None else F.sqrt(direct * curve)


