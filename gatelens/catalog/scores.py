"""Scores, margins, submission checks, model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import fixtures as fx
from gatelens.catalog import query
from gatelens.catalog import sqlviews as v
from gatelens.catalog.common import rounded
from gatelens.operators import scoring

S = """
s AS (SELECT *, log2(true_threshold_min)::INTEGER AS ti, log2(predicted_threshold_min)::INTEGER AS pi,
  CASE WHEN predicted_threshold_min < true_threshold_min THEN 0::DOUBLE ELSE 2.0::DOUBLE ** (log2(true_threshold_min)::INTEGER - log2(predicted_threshold_min)::INTEGER) END AS ts,
  CASE WHEN pred_s > 0 AND true_s > 0 THEN -abs(log2(pred_s / true_s)) END AS rs FROM v_scored),
p AS (SELECT * FROM s WHERE predicted_threshold_min IS NOT NULL)"""


def _scored(spark, sf):
    return fx.v_scored(spark, sf)


def _present(spark, sf):
    return _scored(spark, sf).where("predicted_threshold_min IS NOT NULL")


@query("n1_threshold_score", v.with_views(v.V_SCORED, S, body="SELECT id, round(ts, 6) AS threshold_score FROM p"))
def n1(spark, sf):
    score = scoring.threshold_score(F.col("predicted_threshold_min"), F.col("true_threshold_min"))
    return rounded(_present(spark, sf).select("id", score.alias("threshold_score")))


@query("n2_runtime_log_score", v.with_views(v.V_SCORED, S, body="SELECT id, round(rs, 6) AS runtime_log_score FROM s"))
def n2(spark, sf):
    return rounded(_scored(spark, sf).select("id", scoring.runtime_log_score(F.col("pred_s"), F.col("true_s")).alias("runtime_log_score")))


@query("n3_threshold_metrics", v.with_views(v.V_SCORED, S, body="""
SELECT round(avg(ts), 6) AS mean_threshold_score, count(*) FILTER (WHERE ts = 0) AS n_threshold_failures, count(*) AS n_tasks FROM p"""))
def n3(spark, sf):
    return rounded(scoring.threshold_metrics(_present(spark, sf)))


@query("n4_runtime_metrics", v.with_views(v.V_SCORED, S, body="""
SELECT round(avg(rs), 6) AS mean_runtime_log_score, count(*) FILTER (WHERE rs IS NULL) AS n_runtime_invalid, count(*) AS n_tasks FROM s"""))
def n4(spark, sf):
    return rounded(scoring.runtime_metrics(_scored(spark, sf)))


RAWIDX = "pi + (id % 10) / 10.0::DOUBLE - 0.5::DOUBLE"


def _raw_index():
    return scoring.rung_index(F.col("predicted_threshold_min")) + F.col("id") % 10 / 10.0 - 0.5


@query("n5_asymmetric_loss", v.with_views(v.V_SCORED, S, f"""
r AS (SELECT family, ti, round_even({RAWIDX}, 0) AS ri FROM p)""", body="""
SELECT family, round(avg(CASE WHEN ri < ti THEN 1.0::DOUBLE ELSE 1 - 2.0::DOUBLE ** (ti - ri) END), 6) AS loss FROM r GROUP BY family"""))
def n5(spark, sf):
    true = scoring.rung_index(F.col("true_threshold_min"))
    return rounded(_present(spark, sf).groupBy("family").agg(F.avg(scoring.asymmetric_loss(true, _raw_index())).alias("loss")))


MARGINS = """
m AS (SELECT k / 10.0::DOUBLE AS margin FROM range(0, 11) AS r(k)),
g AS (SELECT margin, avg(CASE WHEN ri < ti THEN 0::DOUBLE ELSE 2.0::DOUBLE ** (ti - ri) END) AS score FROM (
  SELECT margin, ti, least(greatest(round_even({raw} + margin, 0), 0), 8) AS ri FROM p, m) GROUP BY margin)""".format(raw=RAWIDX)


@query("n6_margin_scores", v.with_views(v.V_SCORED, S, MARGINS, body="SELECT round(margin, 6) AS margin, round(score, 6) AS score FROM g"))
def n6_grid(spark, sf):
    return rounded(scoring.margin_scores(_present(spark, sf), scoring.rung_index(F.col("true_threshold_min")), _raw_index()))


@query("n6_best_margin", v.with_views(v.V_SCORED, S, MARGINS, body="""
SELECT round(margin, 6) AS best_margin, round(score, 6) AS best_score FROM g ORDER BY score DESC, margin LIMIT 1"""))
def n6(spark, sf):
    return rounded(scoring.best_margin(_present(spark, sf), scoring.rung_index(F.col("true_threshold_min")), _raw_index()))


SUBMITTED = """
preds AS (SELECT o_custkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(2 ** (o_orderkey % 10) AS INTEGER) END AS thr,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN -1 WHEN o_orderkey % 19 = 0 THEN 'Infinity'::DOUBLE ELSE o_totalprice END AS wall FROM orders),
tasks AS (SELECT DISTINCT o_custkey + 20 AS id FROM orders)"""


def _submission(spark, sf):
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    preds = o.select(F.col("o_custkey").alias("id"), F.when(k % 11 != 0, F.pow(F.lit(2), k % 10).cast("int")).alias("predicted_threshold_min"),
                     F.when(k % 13 == 0, None).when(k % 7 == 0, -1.0).when(k % 19 == 0, float("inf")).otherwise(F.col("o_totalprice"))
                     .alias("predicted_forward_wall_s"))
    return preds, o.select((F.col("o_custkey") + 20).alias("id")).distinct()


@query("n7_validate_submission", v.with_views(SUBMITTED, body="""
SELECT id, 'missing predicted_threshold_min' AS violation FROM preds WHERE thr IS NULL
UNION ALL SELECT id, 'predicted_threshold_min not on the ladder' FROM preds WHERE thr NOT IN (1,2,4,8,16,32,64,128,256)
UNION ALL SELECT id, 'missing predicted_forward_wall_s' FROM preds WHERE wall IS NULL
UNION ALL SELECT id, 'predicted_forward_wall_s not finite and positive' FROM preds WHERE wall <= 0 OR isinf(wall)
UNION ALL SELECT id, 'duplicate id' FROM preds GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'missing prediction' FROM tasks WHERE id NOT IN (SELECT id FROM preds)
UNION ALL SELECT DISTINCT id, 'unknown id' FROM preds WHERE id NOT IN (SELECT id FROM tasks)"""))
def n7(spark, sf):
    return scoring.validate_submission(*_submission(spark, sf))


TASK = """
t AS (SELECT id, CASE WHEN predicted_threshold_min >= true_threshold_min THEN ts ELSE 0 END AS thr,
  CASE WHEN predicted_threshold_min >= true_threshold_min THEN least(pred_s / true_s, true_s / pred_s) ELSE 0 END AS run FROM s)"""


def _tasks(spark, sf):
    sc = _scored(spark, sf)
    preds = sc.where("predicted_threshold_min IS NOT NULL").select("id", "predicted_threshold_min", F.col("pred_s").alias("predicted_forward_wall_s"))
    truth = sc.select("id", "true_threshold_min", F.col("true_s").alias("true_forward_wall_s"))
    return scoring.task_scores(sc.select("id"), preds, truth)


@query("n8_task_scores", v.with_views(v.V_SCORED, S, TASK, body="""
SELECT id, round(thr * run, 6) AS task_score, round(thr, 6) AS threshold_score, round(run, 6) AS runtime_score FROM t"""))
def n8(spark, sf):
    return rounded(_tasks(spark, sf))


@query("n8_overall_score", v.with_views(v.V_SCORED, S, TASK, body="SELECT round(avg(thr * run), 6) AS overall_score, count(*) AS n_tasks FROM t"))
def n8_overall(spark, sf):
    return rounded(scoring.overall_score(_tasks(spark, sf)))


@query("n9_worst_best", v.with_views(v.V_SCORED, S, TASK, """
r AS (SELECT id, round(thr * run, 6) AS task_score, round(thr, 6) AS threshold_score, round(run, 6) AS runtime_score FROM t)""", body="""
(SELECT *, 'worst' AS "end" FROM r ORDER BY task_score, id LIMIT 10) UNION ALL (SELECT *, 'best' FROM r ORDER BY task_score DESC, id DESC LIMIT 10)"""))
def n9(spark, sf):
    return scoring.worst_best(rounded(_tasks(spark, sf)), 10)


@query("n10_compare_models", v.with_views(v.V_SCORED, """
pooled AS (SELECT 'given' AS model, predicted_threshold_min AS pt, true_threshold_min AS tt, pred_s AS p, true_s AS t FROM v_scored WHERE pred_s IS NOT NULL
  UNION ALL SELECT 'top', 256, true_threshold_min, true_s * 2, true_s FROM v_scored)""", body="""
SELECT model, round(avg(CASE WHEN pt < tt THEN 0::DOUBLE ELSE tt / pt END), 6) AS mean_threshold_score, count(*) FILTER (WHERE pt < tt) AS n_threshold_failures,
  count(*) AS n_tasks, round(avg(-abs(log2(p / t))), 6) AS mean_runtime_log_score, 0::BIGINT AS n_runtime_invalid FROM pooled GROUP BY model"""))
def n10(spark, sf):
    sc = _scored(spark, sf)
    top = sc.withColumns({"predicted_threshold_min": F.lit(256), "pred_s": F.col("true_s") * 2})
    return rounded(scoring.compare_models([("given", _present(spark, sf)), ("top", top)]))
