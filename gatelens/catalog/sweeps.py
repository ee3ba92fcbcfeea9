"""Results, sweep curves and nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import fixtures as fx
from gatelens.catalog import query
from gatelens.catalog import sqlviews as v
from gatelens.catalog.common import rounded
from gatelens.operators import sweep
from gatelens.sources import benchmark

K = "file, backend, precision_ AS precision"


def _points(spark, sf):
    return fx.v_sweep(spark, sf)


def _sweep(spark, sf):
    return sweep.explode_sweep(_points(spark, sf))


CURVE = """
c AS (SELECT *, log2(threshold) AS x, lag(fid) OVER w AS pf, lag(log2(threshold)) OVER w AS px, row_number() OVER w AS i,
  row_number() OVER (PARTITION BY file, backend, precision_ ORDER BY threshold DESC) AS bk
  FROM kept WINDOW w AS (PARTITION BY file, backend, precision_ ORDER BY threshold)),
l AS (SELECT *, max(fid - pf) OVER (PARTITION BY file, backend, precision_ ORDER BY threshold ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM c)"""


@query("g1_ok_results", v.with_views(v.V_RESULTS, body=f"SELECT {K}, family FROM v_results WHERE status = 'ok'"))
def g1(spark, sf):
    return sweep.ok_results(fx.v_results(spark, sf)).select(*sweep.KEY, "family")


DOCS = """
docs AS (
  SELECT concat_ws('-', l_suppkey, l_orderkey, l_linenumber, l_partkey) AS file,
    CASE WHEN l_orderkey % 2 = 0 THEN 'CPU' ELSE 'GPU' END AS backend, CASE WHEN l_orderkey % 4 < 2 THEN 'single' ELSE 'double' END AS precision_,
    CASE WHEN l_linestatus = 'F' THEN 'runner_failed' ELSE 'ok' END AS status, CAST(2 ** (l_linenumber - 1) AS INTEGER) AS rung, l_linenumber AS line,
    l_quantity AS q, l_returnflag AS flag FROM lineitem),
pts AS (
  SELECT *, 0 AS pos, rung AS threshold, q / 64 AS fid, 'ok' AS note FROM docs
  UNION ALL SELECT *, 1, rung * 2, q / 32, CASE WHEN flag = 'R' THEN 'mirror_timeout' ELSE 'ok' END FROM docs
  UNION ALL SELECT *, 2, rung, q / 128, CASE WHEN flag = 'R' THEN 'mirror_timeout' ELSE 'ok' END FROM docs)"""


def _results(spark, sf):
    return benchmark.results_from_documents(fx.v_result_documents(spark, sf), "doc")


@query("a1_results_from_documents", v.with_views(DOCS, body=f"""
SELECT {K}, status, pos, threshold, round(fid, 6) AS fid, note FROM pts"""))
def a1(spark, sf):
    return rounded(sweep.sweep_points(_results(spark, sf)).select(*sweep.KEY, "status", "pos", "threshold", "fid", "note"))


@query("g2_flatten_results", v.with_views(DOCS, body=f"""
SELECT {K}, status, rung AS selected_threshold, round(q / 64, 6) AS selected_fidelity, line - 1 AS selected_threshold_log2,
  round(q / 2, 6) AS forward_wall_s, rung AS forward_threshold, 3 AS forward_unique_outcomes, round(q * 4, 6) AS forward_peak_rss_mb,
  NULL::DOUBLE AS estimated_per_shot_s, NULL::DOUBLE AS estimated_setup_s, round(q / 8, 6) AS state_setup_wall_s,
  round(q * 2, 6) AS state_setup_peak_rss_mb, CASE WHEN flag = 'A' THEN round(q / 64, 6) END AS verify_p_return_zero FROM docs"""))
def g2(spark, sf):
    return rounded(sweep.flatten_results(_results(spark, sf)))


@query("g3_explode_sweep", v.with_views(v.V_SWEEP, body=f"""
SELECT {K}, threshold, round(fid, 6) AS fid, round(wall, 6) AS wall, round(rss, 6) AS rss FROM kept"""))
def g3(spark, sf):
    return rounded(_sweep(spark, sf))


@query("g4_pivot_sweep", v.with_views(v.V_SWEEP, body=f"SELECT {K}, " + ", ".join(
    f"max(CASE WHEN threshold = {t} THEN round({c}, 6) END) AS sweep_{c}_{t}" for c in ("fid", "wall", "rss") for t in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512))
    + " FROM kept GROUP BY file, backend, precision_"))
def g4(spark, sf):
    return rounded(sweep.pivot_sweep(_sweep(spark, sf)))


@query("g5_sweep_summary", v.with_views(v.V_SWEEP, CURVE, body=f"""
SELECT {K}, round(min(fid), 6) AS sweep_min_fidelity, round(max(fid), 6) AS sweep_max_fidelity, count(*)::INTEGER AS n_sweep_rungs,
  round(max(CASE WHEN threshold = 1 THEN fid END), 6) AS fidelity_at_1, coalesce(log2(min(CASE WHEN fid >= 0.75 THEN threshold END))::INTEGER, 10) AS rungs_to_099,
  round(coalesce(max(fid - pf), 0), 6) AS biggest_fid_jump,
  coalesce(min(CASE WHEN fid - pf = mj THEN threshold END), min(threshold)) AS biggest_jump_rung
FROM (SELECT *, max(fid - pf) OVER (PARTITION BY file, backend, precision_) AS mj FROM c) GROUP BY file, backend, precision_"""))
def g5(spark, sf):
    return rounded(sweep.sweep_summary(_sweep(spark, sf)))


@query("g6_first_crossing", v.with_views(v.V_SWEEP, """
s AS (SELECT file, backend, precision_, coalesce(min(CASE WHEN fid >= 0.75 THEN threshold END), max(threshold)) AS t FROM kept GROUP BY ALL)""", body="""
SELECT s.file, s.backend, s.precision_ AS precision, t AS selected_threshold, log2(t)::INTEGER AS selected_threshold_log2, round(fid, 6) AS selected_fidelity
FROM s JOIN kept k ON k.file = s.file AND k.backend = s.backend AND k.precision_ = s.precision_ AND k.threshold = s.t"""))
def g6(spark, sf):
    return rounded(sweep.first_crossing(_sweep(spark, sf)))


@query("g7_sweep_curve", v.with_views(v.V_SWEEP, body=f"""
SELECT {K}, string_agg(threshold::VARCHAR, ' ' ORDER BY threshold) AS rungs, string_agg(CAST((fid * 50)::BIGINT AS VARCHAR), ' ' ORDER BY threshold) AS fidelity_50ths
FROM kept GROUP BY file, backend, precision_"""))
def g7(spark, sf):
    text = lambda c, f: F.array_join(F.transform(c, f), " ")
    return sweep.sweep_curve(_sweep(spark, sf)).select(
        *sweep.KEY, text("rungs", lambda r: r.cast("string")).alias("rungs"),
        text("fidelities", lambda y: F.round(y * 50).cast("long").cast("string")).alias("fidelity_50ths"))


@query("g8_convergence_rate", v.with_views(v.V_SWEEP, CURVE, body=f"""
SELECT {K}, round(greatest(coalesce(max((fid - pf) / (x - px)), 0), 0), 6) AS sweep_convergence_rate FROM c GROUP BY file, backend, precision_"""))
def g8(spark, sf):
    return rounded(sweep.convergence_rate(_sweep(spark, sf)))


AREA = "round(coalesce(sum((fid + pf) / 2 * (x - px)) / nullif(max(x) - min(x), 0), 0), 6) AS sweep_area_under_curve"


@query("g9_area_under_curve", v.with_views(v.V_SWEEP, CURVE, body=f"SELECT {K}, {AREA} FROM c GROUP BY file, backend, precision_"))
def g9(spark, sf):
    return rounded(sweep.area_under_curve(_sweep(spark, sf)))


PLATEAU = """
p AS (SELECT file, backend, precision_, count(*) AS n, min(CASE WHEN fid < 0.99 AND later < 0.01 THEN threshold END) AS pt,
  arg_min(fid, threshold) FILTER (WHERE fid < 0.99 AND later < 0.01) AS py, max(threshold) AS lt, arg_max(fid, threshold) AS ly FROM l GROUP BY ALL)"""


@query("g10_detect_plateau", v.with_views(v.V_SWEEP, CURVE, PLATEAU, body=f"""
SELECT {K}, pt IS NOT NULL AND n >= 2 AS has_plateau, round(CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE coalesce(py, ly) END, 6) AS plateau_fidelity,
  CASE WHEN n < 2 THEN 1 ELSE coalesce(pt, lt) END AS plateau_rung FROM p"""))
def g10(spark, sf):
    return rounded(sweep.detect_plateau(_sweep(spark, sf)))


SHAPE = """
m AS (SELECT file, backend, precision_, round(greatest(coalesce(max((fid - pf) / (x - px)), 0), 0), 6) AS sweep_convergence_rate, """ + AREA + """,
  round(var_pop(fid), 6) AS sweep_fidelity_variance, max(fid - pf) AS ms, arg_max(fid, threshold) - arg_min(fid, threshold) AS rg,
  round(avg(CASE WHEN i <= 3 THEN fid END), 6) AS sweep_early_fidelity, round(avg(CASE WHEN bk <= 3 THEN fid END), 6) AS sweep_late_fidelity,
  (count(*) FILTER (WHERE fid < 0.5))::DOUBLE AS sweep_n_rungs_below_05, (count(*) FILTER (WHERE fid < 0.9))::DOUBLE AS sweep_n_rungs_below_09,
  (count(*) FILTER (WHERE fid < 0.99))::DOUBLE AS sweep_n_rungs_below_099 FROM l GROUP BY ALL),
shape AS (SELECT m.* EXCLUDE (ms, rg), (pt IS NOT NULL AND n >= 2)::INTEGER::DOUBLE AS sweep_has_plateau,
  round(CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE coalesce(py, ly) END, 6) AS sweep_plateau_fidelity,
  round(CASE WHEN n < 2 THEN 0 ELSE log2(coalesce(pt, lt)) END, 6) AS sweep_plateau_rung_log2,
  round(CASE WHEN rg > 0 THEN ms / rg ELSE 0 END, 6) AS sweep_threshold_sensitivity, round(rg, 6) AS sweep_fidelity_range
  FROM m JOIN p USING (file, backend, precision_))"""


@query("g11_curve_moments", v.with_views(v.V_SWEEP, CURVE, PLATEAU, SHAPE, body="SELECT * EXCLUDE (precision_), precision_ AS precision FROM shape"))
def g11(spark, sf):
    return rounded(sweep.curve_moments(_sweep(spark, sf)))


@query("g12_add_sweep_features", v.with_views(v.V_SWEEP, v.V_RESULTS, CURVE, PLATEAU, SHAPE, body="SELECT r.file, r.backend, r.precision_ AS precision, " + ", ".join(
    f"coalesce({c}, {x}) AS {c}" for c, x in sweep.NO_CURVE.items()) + """
FROM v_results r LEFT JOIN shape s ON s.file = r.file AND s.backend = r.backend AND s.precision_ = r.precision_"""))
def g12(spark, sf):
    return rounded(sweep.add_sweep_features(fx.v_results(spark, sf).select(*sweep.KEY), _sweep(spark, sf)))


@query("g13_fidelity_drops", v.with_views(v.V_SWEEP, """
okp AS (SELECT * FROM v_sweep WHERE status = 'ok' AND note LIKE '%ok%' AND fid IS NOT NULL),
b AS (SELECT file, fid, lag(fid) OVER (PARTITION BY file, backend, precision_ ORDER BY threshold, pos) AS before FROM okp)""", body=f"""
SELECT {K}, threshold, round(fid, 6) AS fid, count(*) AS n FROM okp WHERE file IN (SELECT file FROM b WHERE fid < before) GROUP BY ALL"""))
def g13(spark, sf):
    drops = sweep.fidelity_drops(_points(spark, sf))
    return drops.groupBy(*sweep.KEY, "threshold", F.round("fid", 6).alias("fid")).agg(F.count(F.lit(1)).alias("n"))


@query("g14_timing_decomposition", v.with_views(v.V_RESULTS, """
t AS (SELECT *, (forward_wall_s - state_setup_wall_s) / 9999 AS ps FROM v_results)""", body=f"""
SELECT {K}, round(ps, 6) AS estimated_per_shot_s, round(state_setup_wall_s - ps, 6) AS estimated_setup_s,
  round(state_setup_wall_s - ps + 10000 * ps, 6) AS total_estimated_10k FROM t"""))
def g14(spark, sf):
    t = sweep.timing_decomposition(fx.v_results(spark, sf))
    return rounded(t.select(*sweep.KEY, "estimated_per_shot_s", "estimated_setup_s", "total_estimated_10k"))
