"""Reporting tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import fixtures as fx
from gatelens.catalog import query
from gatelens.catalog import sqlviews as v
from gatelens.catalog.common import rounded
from gatelens.operators import report


def _results(spark, sf):
    return fx.v_results(spark, sf)


@query("i1_family_summary", v.with_views(v.V_RESULTS, body="""
SELECT family AS true_family, count(DISTINCT file // 3) AS n_circuits, round(avg(selected_threshold), 6) AS mean_threshold, min(selected_threshold) AS min_threshold,
  max(selected_threshold) AS max_threshold, round(avg(forward_wall_s), 6) AS mean_runtime, round(avg(state_setup_wall_s), 6) AS mean_max_cut_pressure
FROM v_results GROUP BY family"""))
def i1(spark, sf):
    r = _results(spark, sf).withColumns({"true_family": F.col("family"), "file": F.floor(F.col("file") / 3), "max_cut_pressure": F.col("state_setup_wall_s")})
    return rounded(report.family_summary(r))


FEATS = fx.FEATURES + ["constant"]


@query("i2_target_correlations", v.with_views(v.V_FEATURES, """
c AS (""" + " UNION ALL ".join(f"""SELECT '{t}' AS target, '{f}' AS feature, abs(corr({f}, {e})) AS abs_r FROM v_features""" for t, e in (
    ("thr", "log2(selected_threshold)"), ("rt", "ln(1 + forward_wall_s)")) for f in FEATS) + ")", body="""
SELECT target, feature, round(abs_r, 6) AS abs_r FROM c WHERE abs_r IS NOT NULL AND NOT isnan(abs_r) QUALIFY row_number() OVER (PARTITION BY target ORDER BY abs_r DESC, feature) <= 4"""))
def i2(spark, sf):
    df = fx.v_features(spark, sf).withColumns({"thr": F.log2("selected_threshold"), "rt": F.log1p("forward_wall_s")})
    return rounded(report.target_correlations(df, FEATS, ["thr", "rt"], 4))


@query("i3_value_counts", v.with_views(v.V_RESULTS, body="""
SELECT selected_threshold AS value, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS share FROM v_results WHERE selected_threshold IS NOT NULL GROUP BY 1"""))
def i3(spark, sf):
    return rounded(report.value_counts(_results(spark, sf), "selected_threshold"))


def _gapped(spark, sf):
    far = F.when(F.col("file") % 3 == 0, 5 * F.col("forward_wall_s") + 1000000).otherwise(F.col("forward_wall_s"))
    return _results(spark, sf).withColumn("forward_wall_s", far)


@query("i4_histogram", v.with_views(v.V_RESULTS, """
g AS (SELECT CASE WHEN file % 3 = 0 THEN 5 * forward_wall_s + 1000000 ELSE forward_wall_s END AS s FROM v_results),
l AS (SELECT min(s) AS lo, max(s) AS hi FROM g),
b AS (SELECT least(floor((s - lo) / (hi - lo) * 30), 29)::INTEGER AS bin FROM g, l)""", body="""
SELECT r.i::INTEGER AS bin, round(lo + r.i * (hi - lo) / 30, 6) AS lo, round(lo + (r.i + 1) * (hi - lo) / 30, 6) AS hi,
  (SELECT count(*) FROM b WHERE b.bin = r.i) AS n FROM l, range(30) r(i)"""))
def i4(spark, sf):
    """A third of the range holds no value, so that empty bins show."""
    return rounded(report.histogram(_gapped(spark, sf), "forward_wall_s", 30))


@query("i5_mean_curve", v.with_views(v.V_SWEEP, body="""
SELECT file, threshold, round(avg(fid), 6) AS mean_fidelity, round(avg(wall), 6) AS mean_wall, count(*) AS n FROM v_sweep WHERE status = 'ok' AND note LIKE '%ok%' AND fid IS NOT NULL GROUP BY 1, 2"""))
def i5(spark, sf):
    return rounded(report.mean_curve(fx.v_sweep(spark, sf), ["file"]))


@query("i5_mean_curve_by_family", v.with_views(v.V_SWEEP, v.V_RESULTS, body="""
SELECT family, threshold, round(avg(fid), 6) AS mean_fidelity, round(avg(wall), 6) AS mean_wall, count(*) AS n FROM v_sweep s JOIN v_results r ON r.file = s.file
WHERE note LIKE '%ok%' AND s.status = 'ok' AND fid IS NOT NULL AND r.status = 'ok' GROUP BY 1, 2"""))
def i5_family(spark, sf):
    ok = _results(spark, sf).where("status = 'ok'").select("file", "family")
    return rounded(report.mean_curve(fx.v_sweep(spark, sf).join(ok, "file"), ["family"]))


@query("i6_timeouts_by_rung", v.with_views(v.V_SWEEP, body="""
SELECT threshold, count(*) AS total, count(*) FILTER (WHERE note = 'mirror_TimeOut') AS timeouts, count(*) FILTER (WHERE note IS NULL OR note <> 'mirror_TimeOut') AS ok_count FROM v_sweep GROUP BY 1"""))
def i6(spark, sf):
    return report.timeouts_by_rung(fx.v_sweep(spark, sf))


@query("i7_return_codes", v.with_views(v.V_SWEEP, body="SELECT returncode, count(*) AS n FROM v_sweep WHERE returncode IS NOT NULL GROUP BY 1"))
def i7(spark, sf):
    return report.return_codes(fx.v_sweep(spark, sf))


@query("i7_notes", v.with_views(v.V_SWEEP, body="SELECT coalesce(note, '(null)') AS note, count(*) AS n FROM v_sweep GROUP BY 1"))
def i7_notes(spark, sf):
    return report.notes(fx.v_sweep(spark, sf))


@query("i8_first_per_config", v.with_views(v.V_SWEEP, body="""
SELECT file, backend, precision_ AS precision, threshold, round(arg_min(p0, pos) FILTER (WHERE p0 IS NOT NULL), 6) AS p0,
  (arg_min(returncode, pos) FILTER (WHERE returncode IS NOT NULL))::DOUBLE AS returncode, arg_min(note, pos) FILTER (WHERE note IS NOT NULL) AS note
FROM v_sweep GROUP BY file, backend, precision_, threshold"""))
def i8(spark, sf):
    points = fx.v_sweep(spark, sf).withColumn("returncode", F.col("returncode").cast("double"))
    return rounded(report.first_per_config(points, ["p0", "returncode", "note"]))


CORR = ["n_qubits", "selected_threshold", "forward_wall_s", "state_setup_wall_s"]


@query("i9_correlation_matrix", v.with_views(v.V_RESULTS, body=" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM v_results WHERE status = 'ok'" for i, a in enumerate(CORR) for b in CORR[i:])))
def i9(spark, sf):
    ok = _results(spark, sf).where("status = 'ok'").withColumn("never", F.lit(None).cast("double"))
    return rounded(report.correlation_matrix(ok, [*CORR, "never"]))


@query("i10_box_summary", v.with_views(v.V_RESULTS, """
d AS (SELECT family AS grp, ln(forward_wall_s) AS x FROM v_results WHERE status = 'ok'),
q AS (SELECT grp, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM d GROUP BY grp)""", body="""
SELECT grp, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers, count(*) AS n FROM d JOIN q USING (grp) GROUP BY grp, q1, med, q3"""))
def i10(spark, sf):
    ok = _results(spark, sf).where("status = 'ok'").withColumn("x", F.log("forward_wall_s"))
    return rounded(report.box_summary(ok, "x", "family"))


@query("i11_results_per_circuit", """
SELECT c.o_orderkey AS file, count(l_orderkey) AS n_results FROM orders c LEFT JOIN lineitem ON l_orderkey = c.o_orderkey GROUP BY 1""")
def i11(spark, sf):
    circuits = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"))
    return report.results_per_circuit(circuits, fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file")))


@query("i12_long_sweep", v.with_views(v.V_SWEEP, v.V_RESULTS, body="""
SELECT s.file, s.threshold, round(s.fid, 6) AS fid, round(s.wall, 6) AS wall, s.note, r.family, r.n_qubits FROM v_sweep s LEFT JOIN v_results r ON r.file = s.file"""))
def i12(spark, sf):
    long = report.long_sweep(fx.v_sweep(spark, sf), _results(spark, sf))
    return rounded(long.select("file", "threshold", "fid", "wall", "note", "family", "n_qubits"))


@query("i13_scatter_sample", v.with_views(v.V_RESULTS, """
f AS (SELECT family, min(file) AS first FROM v_results GROUP BY family ORDER BY first, family LIMIT 3)""", body="""
SELECT file, family, n_qubits, round(forward_wall_s, 6) AS forward_wall_s FROM v_results WHERE family IN (SELECT family FROM f)"""))
def i13(spark, sf):
    return rounded(report.scatter_sample(_results(spark, sf).select("file", "family", "n_qubits", "forward_wall_s"), "family", "file", 3))


@query("i14_size_bucket", v.with_views(v.V_RESULTS, body="""
SELECT file, CASE WHEN n_qubits <= 20 THEN 'small' WHEN n_qubits BETWEEN 21 AND 60 THEN 'medium' WHEN n_qubits >= 100 THEN 'large' END AS size FROM v_results"""))
def i14(spark, sf):
    return _results(spark, sf).select("file", report.size_bucket(F.col("n_qubits")).alias("size"))
