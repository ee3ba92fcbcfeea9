"""Scoring, margins, submission checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.constants import RUNGS_SCORING
from gatelens.functions.exprs import d, finite, half_even


def rung_index(threshold: Column) -> Column:
    return F.floor(F.log2(threshold.cast("double"))).cast("int")


def threshold_score(pred: Column, true: Column) -> Column:
    """0 below the truth, else 2^-(rungs over)."""
    return F.when(pred < true, 0.0).otherwise(F.pow(F.lit(2.0), rung_index(true) - rung_index(pred)))


def runtime_log_score(pred: Column, true: Column) -> Column:
    """-|log2(pred / true)|, NULL unless both are finite and positive."""
    p, t = finite(pred), finite(true)
    return F.when((p > 0) & (t > 0), -F.abs(F.log2(p / t)))


def threshold_metrics(scored: DataFrame, by: list[str] | None = None, pred: str = "predicted_threshold_min",
                      true: str = "true_threshold_min") -> DataFrame:
    """Mean score, failures, rows."""
    score = threshold_score(F.col(pred), F.col(true))
    return scored.groupBy(*(by or [])).agg(
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_threshold_score"), F.count(F.when(score == 0, 1)).alias("n_threshold_failures"),
        F.count(F.lit(1)).alias("n_tasks"))


def runtime_metrics(scored: DataFrame, by: list[str] | None = None, pred: str = "pred_s", true: str = "true_s") -> DataFrame:
    """Mean log score over the valid rows, invalid count, rows."""
    score = runtime_log_score(F.col(pred), F.col(true))
    return scored.groupBy(*(by or [])).agg(
        F.avg(score).alias("mean_runtime_log_score"), F.count(F.when(score.isNull(), 1)).alias("n_runtime_invalid"),
        F.count(F.lit(1)).alias("n_tasks"))


def asymmetric_loss(true_idx: Column, pred_idx: Column) -> Column:
    """N5, per row: 1 below the truth, else 1 - 2^-(rungs over), on the half-even rounded index."""
    p = half_even(pred_idx)
    return F.when(p < true_idx, 1.0).otherwise(1.0 - F.pow(F.lit(2.0), true_idx - p))


MARGINS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def margin_scores(scored: DataFrame, true_idx: Column, raw: Column, margins: list[float] = MARGINS) -> DataFrame:
    """(margin, score) for each margin, from one pass over the rows."""
    top = len(RUNGS_SCORING) - 1
    def score(m: float) -> Column:
        p = F.least(F.greatest(half_even(raw + F.lit(m)), F.lit(0.0)), F.lit(float(top)))
        return F.avg(F.when(p < true_idx, 0.0).otherwise(F.pow(F.lit(2.0), true_idx - p)))
    one = scored.agg(*[score(m).alias(f"s{i}") for i, m in enumerate(margins)])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("margin"), F.col(f"s{i}").alias("score")) for i, m in enumerate(margins)])).alias("m")).select("m.*")


def best_margin(scored: DataFrame, true_idx: Column, raw: Column, margins: list[float] = MARGINS) -> DataFrame:
    """The margin of the best mean score, the smallest on ties."""
    best = F.max(F.struct("score", (-F.col("margin")).alias("neg")))
    return margin_scores(scored, true_idx, raw, margins).agg(best.alias("b")).select(
        F.abs(-F.col("b.neg")).alias("best_margin"), F.col("b.score").alias("best_score"))


def validate_submission(preds: DataFrame, tasks: DataFrame) -> DataFrame:
    """(id, violation) for every broken rule; ``preds`` has (id, predicted_threshold_min, predicted_forward_wall_s)."""
    thr, wall = F.col("predicted_threshold_min"), F.col("predicted_forward_wall_s")
    rules = [
        ("missing id", F.col("id").isNull()),
        ("missing predicted_threshold_min", thr.isNull()),
        ("predicted_threshold_min not on the ladder", thr.isNotNull() & ~thr.isin(RUNGS_SCORING)),
        ("missing predicted_forward_wall_s", wall.isNull()),
        ("predicted_forward_wall_s not finite and positive", wall.isNotNull() & (finite(wall).isNull() | (wall <= 0))),
    ]
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for text, cond in rules]))
    fields = preds.select("id", F.explode(broken).alias("violation"))
    # one aggregation by id finds duplicates, missing and unknown ids together
    sides = preds.where(F.col("id").isNotNull()).select("id", F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(
        tasks.select("id", F.lit(0).alias("p"), F.lit(1).alias("t")))
    found = sides.groupBy("id").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    texts = F.array_compact(F.array(
        F.when(F.col("p") > 1, F.lit("duplicate id")), F.when((F.col("p") == 0), F.lit("missing prediction")),
        F.when((F.col("t") == 0), F.lit("unknown id"))))
    return fields.unionByName(found.select("id", F.explode(texts).alias("violation")))


def require_valid(preds: DataFrame, tasks: DataFrame) -> None:
    """Strict form: raise on the first violation."""
    bad = validate_submission(preds, tasks).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].violation}: id={bad[0].id}")


def task_scores(tasks: DataFrame, preds: DataFrame, truth: DataFrame) -> DataFrame:
    """(id, task_score, threshold_score, runtime_score); missing or too low a threshold scores 0 throughout."""
    joined = tasks.select("id").join(preds, "id", "left").join(truth, "id", "left")
    pred, true = F.col("predicted_threshold_min"), F.col("true_threshold_min")
    passed = pred.isNotNull() & (pred >= true)
    r = F.col("predicted_forward_wall_s") / F.col("true_forward_wall_s")
    thr = F.when(passed, threshold_score(pred, true)).otherwise(0.0)
    run = F.when(passed, F.least(r, 1.0 / r)).otherwise(0.0)
    return joined.select("id", (thr * run).alias("task_score"), thr.alias("threshold_score"), run.alias("runtime_score"))


def overall_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("task_score").alias("overall_score"), F.count(F.lit(1)).alias("n_tasks"))


def worst_best(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k lowest and k highest tasks; ties by id."""
    low = scores.orderBy("task_score", "id").limit(k).withColumn("end", F.lit("worst"))
    high = scores.orderBy(F.col("task_score").desc(), F.col("id").desc()).limit(k).withColumn("end", F.lit("best"))
    return low.unionByName(high)


def compare_models(predictions: list[tuple[str, DataFrame]]) -> DataFrame:
    """Pooled out-of-fold metrics per model; each frame has both predictions and both truths."""
    pooled = reduce(DataFrame.unionByName, [df.withColumn("model", F.lit(name)) for name, df in predictions])
    t, r = threshold_metrics(pooled, ["model"]), runtime_metrics(pooled, ["model"]).drop("n_tasks")
    return t.join(r, "model")
