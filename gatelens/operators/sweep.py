"""Results and threshold-sweep curves.

A configuration is (file, backend, precision). Raw sweep points may repeat a rung any number of times, so points are
first reduced to one per rung by a partial aggregation; every later window then sees at most the ladder's rungs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelens.constants import RUNGS_LOADER, TARGET_FIDELITY
from gatelens.functions.exprs import d, finite

KEY = ["file", "backend", "precision"]


def ok_results(results: DataFrame) -> DataFrame:
    """G1."""
    return results.where(F.col("status") == "ok")


def flatten_results(results: DataFrame) -> DataFrame:
    """Nested result fields as flat columns, plus log2 of the recorded threshold."""
    thr = F.col("selection.selected_threshold")
    return results.select(
        *KEY, "status", thr.alias("selected_threshold"),
        F.col("selection.selected_mirror_metric_value").alias("selected_fidelity"),
        F.floor(F.log2(thr)).cast("int").alias("selected_threshold_log2"),
        F.col("forward.run_wall_s").alias("forward_wall_s"), F.col("forward.threshold").alias("forward_threshold"),
        F.col("forward.unique_outcomes").alias("forward_unique_outcomes"),
        F.col("forward.peak_rss_mb").alias("forward_peak_rss_mb"),
        F.col("forward_timing_estimates.estimated_per_shot_s"), F.col("forward_timing_estimates.estimated_setup_s"),
        F.col("state_setup.run_wall_s").alias("state_setup_wall_s"),
        F.col("state_setup.peak_rss_mb").alias("state_setup_peak_rss_mb"),
        F.col("verify.p_return_zero").alias("verify_p_return_zero"))


def sweep_points(results: DataFrame) -> DataFrame:
    """Every sweep entry of every result: (key, pos, threshold, fid, wall, rss, p0, returncode, note)."""
    rows = results.select(*KEY, "status", F.posexplode("threshold_sweep").alias("pos", "s"))
    return rows.select(*KEY, "status", "pos", "s.threshold", F.col("s.sdk_get_fidelity").alias("fid"),
                       F.col("s.run_wall_s").alias("wall"), F.col("s.peak_rss_mb").alias("rss"),
                       F.col("s.p_return_zero").alias("p0"), "s.returncode", "s.note")


def not_timed_out() -> Column:
    return F.col("note").isNull() | ~F.lower("note").contains("timeout")


def explode_sweep(points: DataFrame) -> DataFrame:
    """One row per configuration and ladder rung; timeouts are skipped and a later duplicate wins."""
    kept = points.where(F.col("threshold").isin(RUNGS_LOADER) & not_timed_out())
    last = kept.groupBy(*KEY, "threshold").agg(F.max_by(F.struct("fid", "wall", "rss"), "pos").alias("s"))
    return last.select(*KEY, "threshold", "s.fid", "s.wall", "s.rss")


def pivot_sweep(sweep: DataFrame) -> DataFrame:
    """Columns sweep_{fid,wall,rss}_{rung}."""
    value = lambda c, t: F.max(F.when(F.col("threshold") == t, F.col(c)))
    return sweep.groupBy(*KEY).agg(*[value(c, t).alias(f"sweep_{c}_{t}") for c in ("fid", "wall", "rss") for t in RUNGS_LOADER])


def _curve(sweep: DataFrame) -> DataFrame:
    """(key, threshold, y): points with a fidelity."""
    return sweep.where(F.col("fid").isNotNull()).select(*KEY, "threshold", F.col("fid").alias("y"))


def _steps(curve: DataFrame) -> DataFrame:
    """Adds the previous and the first point of the configuration."""
    order = Window.partitionBy(*KEY).orderBy("threshold")
    return curve.withColumns({
        "x": F.log2("threshold"), "prev_y": F.lag("y").over(order), "prev_x": F.lag(F.log2("threshold")).over(order),
        "i": F.row_number().over(order), "prev_t": F.lag("threshold").over(order)})


def sweep_summary(sweep: DataFrame, target: float = TARGET_FIDELITY) -> DataFrame:
    """Range, rung count, fidelity at 1, log2 of the first rung at target (else 10), biggest jump and its rung."""
    s = _steps(_curve(sweep))
    jump = F.col("y") - F.col("prev_y")
    crossed = F.min(F.when(F.col("y") >= target, F.col("threshold")))
    agg = s.groupBy(*KEY).agg(
        F.min("y").alias("sweep_min_fidelity"), F.max("y").alias("sweep_max_fidelity"), F.count("y").cast("int").alias("n_sweep_rungs"),
        F.max(F.when(F.col("threshold") == 1, F.col("y"))).alias("fidelity_at_1"),
        F.coalesce(F.log2(crossed).cast("int"), F.lit(10)).alias("rungs_to_099"),
        F.max(F.when(jump.isNotNull(), F.struct(jump.alias("jump"), (-F.col("threshold")).alias("neg")))).alias("j"),
        F.min("threshold").alias("first"))
    return agg.select(*KEY, "sweep_min_fidelity", "sweep_max_fidelity", "n_sweep_rungs", "fidelity_at_1", "rungs_to_099",
                      F.coalesce("j.jump", F.lit(0.0)).alias("biggest_fid_jump"),
                      F.coalesce(-F.col("j.neg"), "first").alias("biggest_jump_rung"))


def first_crossing(sweep: DataFrame, target: float = TARGET_FIDELITY) -> DataFrame:
    """Smallest rung at target, else the largest rung, with its fidelity."""
    curve = _curve(sweep)
    at = F.coalesce(F.min(F.when(F.col("y") >= target, F.struct("threshold", "y"))), F.max(F.struct("threshold", "y")))
    return curve.groupBy(*KEY).agg(at.alias("s")).select(
        *KEY, F.col("s.threshold").alias("selected_threshold"), F.log2("s.threshold").cast("int").alias("selected_threshold_log2"),
        F.col("s.y").alias("selected_fidelity"))


def labels(results: DataFrame, sweep: DataFrame, target: float = TARGET_FIDELITY) -> DataFrame:
    """Flat ok-results with sweep columns; the crossing overrides the recorded selection where a sweep exists."""
    flat = flatten_results(ok_results(results)).drop("status")
    cross = first_crossing(sweep, target).select(*KEY, *[F.col(c).alias(f"x_{c}") for c in (
        "selected_threshold", "selected_threshold_log2", "selected_fidelity")])
    joined = flat.join(cross, KEY, "left").join(pivot_sweep(sweep), KEY, "left").join(sweep_summary(sweep, target), KEY, "left")
    for c in ("selected_threshold", "selected_threshold_log2", "selected_fidelity"):
        joined = joined.withColumn(c, F.coalesce(f"x_{c}", c)).drop(f"x_{c}")
    return joined.na.fill({"n_sweep_rungs": 0, "rungs_to_099": 10})


def sweep_curve(sweep: DataFrame) -> DataFrame:
    """(key, rungs, fidelities) of the finite points in rung order (at most ten)."""
    points = sweep.withColumn("y", finite("fid")).where("y IS NOT NULL")
    agg = points.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("threshold", "y"))).alias("c"))
    return agg.select(*KEY, F.col("c.threshold").alias("rungs"), F.col("c.y").alias("fidelities"))


def _finite_curve(sweep: DataFrame) -> DataFrame:
    return sweep.select(*KEY, "threshold", finite("fid").alias("y")).where("y IS NOT NULL")


def convergence_rate(sweep: DataFrame) -> DataFrame:
    """Steepest slope per log2 rung, at least 0."""
    slope = (F.col("y") - F.col("prev_y")) / (F.col("x") - F.col("prev_x"))
    return _steps(_finite_curve(sweep)).groupBy(*KEY).agg(F.greatest(F.coalesce(F.max(slope), F.lit(0.0)), F.lit(0.0)).alias("sweep_convergence_rate"))


def _area() -> Column:
    area = F.sum((F.col("y") + F.col("prev_y")) / 2 * (F.col("x") - F.col("prev_x")))
    return F.coalesce(F.try_divide(area, F.max("x") - F.min("x")), F.lit(0.0))


def area_under_curve(sweep: DataFrame) -> DataFrame:
    """Trapezoid area in log2 rung over its width; 0 below two points."""
    return _steps(_finite_curve(sweep)).groupBy(*KEY).agg(_area().alias("sweep_area_under_curve"))


def _with_later_step(steps: DataFrame) -> DataFrame:
    """Adds the largest step from this point on (NULL at the last point)."""
    later = Window.partitionBy(*KEY).orderBy("threshold").rowsBetween(1, Window.unboundedFollowing)
    return steps.withColumn("later", F.max(F.col("y") - F.col("prev_y")).over(later))


def _plateau(flat: float) -> Column:
    """Aggregate: first point below 0.99 with only small steps after it."""
    return F.min(F.when((F.col("y") < 0.99) & (F.col("later") < flat), F.struct("threshold", "y")))


def detect_plateau(sweep: DataFrame, flat: float = 0.01) -> DataFrame:
    """(has_plateau, plateau_fidelity, plateau_rung); below two points (false, 1.0, 1)."""
    agg = _with_later_step(_steps(_finite_curve(sweep))).groupBy(*KEY).agg(
        _plateau(flat).alias("p"), F.max(F.struct("threshold", "y")).alias("last"), F.count("y").alias("n"))
    short = F.col("n") < 2
    at = F.coalesce("p", "last")
    return agg.select(*KEY, (F.col("p").isNotNull() & ~short).alias("has_plateau"),
                      F.when(short, 1.0).otherwise(at["y"]).alias("plateau_fidelity"),
                      F.when(short, 1).otherwise(at["threshold"]).alias("plateau_rung"))


# ---- fixed values: shape features of a configuration without sweep data -----------------
NO_CURVE = {
    "sweep_convergence_rate": 0.0, "sweep_area_under_curve": 0.0, "sweep_has_plateau": 0.0, "sweep_plateau_fidelity": 1.0,
    "sweep_plateau_rung_log2": 0.0, "sweep_fidelity_variance": 0.0, "sweep_threshold_sensitivity": 0.0,
    "sweep_early_fidelity": 0.0, "sweep_late_fidelity": 1.0, "sweep_fidelity_range": 0.0,
    "sweep_n_rungs_below_05": 0.0, "sweep_n_rungs_below_09": 0.0, "sweep_n_rungs_below_099": 0.0,
}


def curve_moments(sweep: DataFrame, flat: float = 0.01) -> DataFrame:
    """G8 to G11 in one pass: all 13 shape features of configurations with at least one finite point."""
    back = Window.partitionBy(*KEY).orderBy(F.col("threshold").desc())
    s = _with_later_step(_steps(_finite_curve(sweep))).withColumn("back", F.row_number().over(back))
    y, step = F.col("y"), F.col("y") - F.col("prev_y")
    below = lambda t: d(F.count(F.when(y < t, 1)))
    agg = s.groupBy(*KEY).agg(
        F.greatest(F.coalesce(F.max(step / (F.col("x") - F.col("prev_x"))), F.lit(0.0)), F.lit(0.0)).alias("sweep_convergence_rate"),
        _area().alias("sweep_area_under_curve"), _plateau(flat).alias("p"), F.count(y).alias("n"),
        F.max(F.struct("threshold", "y")).alias("last"), F.min(F.struct("threshold", "y")).alias("first"),
        F.var_pop(y).alias("sweep_fidelity_variance"), F.max(step).alias("max_step"),
        F.avg(F.when(F.col("i") <= 3, y)).alias("sweep_early_fidelity"), F.avg(F.when(F.col("back") <= 3, y)).alias("sweep_late_fidelity"),
        below(0.5).alias("sweep_n_rungs_below_05"), below(0.9).alias("sweep_n_rungs_below_09"), below(0.99).alias("sweep_n_rungs_below_099"))
    short = F.col("n") < 2
    at, span = F.coalesce("p", "last"), F.col("last.y") - F.col("first.y")
    return agg.select(
        *KEY, "sweep_convergence_rate", "sweep_area_under_curve", d((F.col("p").isNotNull() & ~short).cast("int")).alias("sweep_has_plateau"),
        F.when(short, 1.0).otherwise(at["y"]).alias("sweep_plateau_fidelity"),
        F.when(short, 0.0).otherwise(F.log2(at["threshold"])).alias("sweep_plateau_rung_log2"),
        "sweep_fidelity_variance", F.when(span > 0, F.try_divide(F.col("max_step"), span)).otherwise(0.0).alias("sweep_threshold_sensitivity"),
        "sweep_early_fidelity", "sweep_late_fidelity", span.alias("sweep_fidelity_range"),
        "sweep_n_rungs_below_05", "sweep_n_rungs_below_09", "sweep_n_rungs_below_099")


def add_sweep_features(frame: DataFrame, sweep: DataFrame) -> DataFrame:
    """The frame with the 13 shape columns, defaults where there is no curve."""
    return frame.join(curve_moments(sweep), KEY, "left").na.fill(NO_CURVE)


def fidelity_drops(points: DataFrame) -> DataFrame:
    """Points of the configurations whose fidelity falls from one point to the next in order of rung and record.

    Only ok points of ok runs count. A fall is a point below the one before it within its rung, or a rung's first point
    below the last point of the rung before it.
    """
    ok = points.where((F.col("status") == "ok") & F.col("note").contains("ok") & F.col("fid").isNotNull())
    order = Window.partitionBy(*KEY).orderBy("threshold")
    rungs = ok.groupBy(*KEY, "threshold").agg(F.min_by("fid", "pos").alias("first"), F.max_by("fid", "pos").alias("last"))
    between = rungs.withColumn("before", F.lag("last").over(order)).where(F.col("first") < F.col("before")).select(*KEY)
    recorded = Window.partitionBy(*KEY, "threshold").orderBy("pos")
    inside = ok.withColumn("before", F.lag("fid").over(recorded)).where(F.col("fid") < F.col("before")).select(*KEY)
    return ok.join(between.unionByName(inside).distinct(), KEY, "left_semi")


def timing_decomposition(results: DataFrame, shots_forward: int = 10000, shots_setup: int = 1) -> DataFrame:
    """Per-shot and setup seconds from two runs, and the 10,000-shot estimate."""
    per_shot = (F.col("forward_wall_s") - F.col("state_setup_wall_s")) / (shots_forward - shots_setup)
    setup = F.col("state_setup_wall_s") - per_shot * shots_setup
    return results.withColumns({"estimated_per_shot_s": per_shot, "estimated_setup_s": setup,
                                "total_estimated_10k": setup + 10000 * per_shot})
