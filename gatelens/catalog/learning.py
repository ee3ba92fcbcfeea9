"""Feature selection, splits, bucketed baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import fixtures as fx
from gatelens.catalog import query
from gatelens.catalog import sqlviews as v
from gatelens.catalog.common import rounded
from gatelens.functions.lineage import cut
from gatelens.operators import selection, splits
from gatelens.operators.baseline import BucketBaseline, FoldedBaseline, normalize_mode

FEATS = fx.FEATURES + ["constant"]
TARGETS = {"threshold": "log2(selected_threshold)", "runtime": "ln(1 + forward_wall_s)"}


def _features(spark, sf):
    return fx.v_features(spark, sf)


def _stored(spark, sf, *extra):
    """The columns of a feature frame as a stored table, as the training jobs read it."""
    return cut(fx.v_features(spark, sf).select("id", *fx.FEATURES, "selected_threshold", "forward_wall_s", *extra))


SCORES = "sc AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS target, {i} AS idx, '{f}' AS feature, coalesce(CASE WHEN stddev_pop({f}) < 1e-6 THEN 0 ELSE abs(corr({f}, {e})) END, 0) AS score FROM v_features"
    for t, e in TARGETS.items() for i, f in enumerate(FEATS)) + ")"


@query("j1_select_by_correlation", v.with_views(v.V_FEATURES, SCORES, body="""
SELECT CAST(row_number() OVER (ORDER BY score DESC, idx) AS INTEGER) AS rank, feature, round(score, 6) AS score FROM sc WHERE target = 'runtime' QUALIFY rank <= 5"""))
def j1(spark, sf):
    return rounded(selection.select_by_correlation(_features(spark, sf), FEATS, selection.log_runtime(), 5))


def _mi_sql(t, e):
    cols = fx.FEATURES
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS e_{c}" for c in cols + ["y"])
    parts = " UNION ALL ".join(f"""SELECT '{t}' AS target, {i} AS idx, '{c}' AS feature, len(list_filter(e_{c}, lambda q: q <= {c})) AS bx,
      len(list_filter(e_y, lambda q: q <= y)) AS by_ FROM d, ed WHERE {c} IS NOT NULL AND y IS NOT NULL""" for i, c in enumerate(cols))
    return f"""
d AS (SELECT {', '.join(cols)}, {e} AS y FROM v_features), ed AS (SELECT {edges} FROM d), bins AS ({parts}),
ct AS (SELECT target, idx, feature, bx, by_, count(*)::DOUBLE AS n FROM bins GROUP BY ALL),
tt AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS tot, sum(n) OVER (PARTITION BY feature, bx) AS nx, sum(n) OVER (PARTITION BY feature, by_) AS ny FROM ct)"""


@query("j2_select_by_mutual_info", v.with_views(v.V_FEATURES, _mi_sql("runtime", TARGETS["runtime"]), body="""
SELECT CAST(row_number() OVER (ORDER BY score DESC, idx) AS INTEGER) AS rank, feature, round(score, 6) AS score FROM (
  SELECT idx, feature, greatest(sum(n / tot * ln(n * tot / (nx * ny))), 0) AS score FROM tt GROUP BY 1, 2) QUALIFY rank <= 5"""))
def j2(spark, sf):
    return rounded(selection.select_by_mutual_info(_stored(spark, sf), fx.FEATURES, selection.log_runtime(), 5))


NEAR = ["n_lines", "sum_qty", "max_price"]


def _psi(n: str) -> str:
    m = f"({n} + 8.0::DOUBLE)"
    series = f"ln{m} - 1 / (2 * {m}) - 1 / (12 * {m} ** 2) + 1 / (120 * {m} ** 4) - 1 / (252 * {m} ** 6)"
    return f"({series} - " + " - ".join(f"1 / ({n} + {i}.0::DOUBLE)" for i in range(8)) + ")"


def _near_sql(target: str) -> str:
    """All pairs of points: the fourth least distance (the point itself is the first), then counts by range windows."""
    names = [f"x{i}" for i in range(len(NEAR))] + ["y0"]
    columns = ", ".join(f"{e} AS {n}" for n, e in zip(names, [*NEAR, target]))
    place = ", ".join(f"""CAST(floor(({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () * 17592186044416.0::DOUBLE) AS BIGINT)
      + CAST(floor(CAST('0x' || substr(md5(id || '#{n}'), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE
        * (4e-10::DOUBLE * greatest(1, avg(abs({n})) OVER () / stddev_pop({n}) OVER ()) * 17592186044416.0::DOUBLE)) AS BIGINT) AS {n}""" for n in names)
    points = " UNION ALL ".join(f"SELECT {i} AS idx, '{f}' AS feature, id, x{i} AS x, y0 AS y FROM gr WHERE x{i} IS NOT NULL AND y0 IS NOT NULL" for i, f in enumerate(NEAR))
    return f"""
raw AS (SELECT id, {columns} FROM v_features), gr AS MATERIALIZED (SELECT id, {place} FROM raw), pt AS MATERIALIZED ({points}),
rd AS (SELECT a.idx, a.feature, a.id, a.x, a.y, greatest(min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 4)[4] - 1, 0) AS r
  FROM pt a JOIN pt b ON a.idx = b.idx GROUP BY ALL),
nn AS (SELECT idx, feature, count(*) OVER (PARTITION BY idx ORDER BY x RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS nx,
  count(*) OVER (PARTITION BY idx ORDER BY y RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS ny FROM rd)"""


@query("j2_select_by_nearest_info", v.with_views(v.V_FEATURES, _near_sql(TARGETS["runtime"]), body=f"""
SELECT CAST(row_number() OVER (ORDER BY score DESC, idx) AS INTEGER) AS rank, feature, round(score, 6) AS score FROM (
  SELECT idx, feature, greatest(0, {_psi("count(*)")} + {_psi("3")} - avg({_psi("nx")}) - avg({_psi("ny")})) AS score FROM nn GROUP BY 1, 2)"""))
def j2_nearest(spark, sf):
    return rounded(selection.select_by_nearest_info(_stored(spark, sf), "id", NEAR, selection.log_runtime(), 3))


@query("j3_select_combined", v.with_views(v.V_FEATURES, SCORES, body="""
SELECT CAST(row_number() OVER (ORDER BY score DESC, idx) AS INTEGER) AS rank, feature, round(score, 6) AS score FROM (
  SELECT idx, feature, max(score) AS score FROM sc GROUP BY 1, 2) QUALIFY rank <= 5"""))
def j3(spark, sf):
    return rounded(selection.select_combined(_features(spark, sf), FEATS, selection.log_threshold(), selection.log_runtime(), 5))


@query("j4_feature_selector", v.with_views(v.V_FEATURES, SCORES, body="""
SELECT target, CAST(row_number() OVER (PARTITION BY target ORDER BY score DESC, idx) AS INTEGER) AS rank, feature, round(score, 6) AS score
FROM sc QUALIFY rank <= CASE WHEN target = 'threshold' THEN 3 ELSE 4 END"""))
def j4(spark, sf):
    return rounded(selection.FeatureSelector(3, 4).rank(_features(spark, sf), FEATS))


# ------------------------------------------------------------------ splits

FOLDS = """
sz AS (SELECT grp, count(*) AS n FROM v_features GROUP BY grp),
rk AS (SELECT grp, n, row_number() OVER (ORDER BY n DESC, md5(grp::VARCHAR), grp) AS i FROM sz),
folds AS (WITH RECURSIVE st AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS grp, 0::BIGINT AS n, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS l UNION ALL
    SELECT rk.i, rk.grp, rk.n, f, list_transform(range(5), lambda j: l[j + 1] + CASE WHEN j = f THEN rk.n ELSE 0 END)
    FROM (SELECT i, l, (list_min(list_transform(range(5), lambda j: l[j + 1] * 8 + j)) % 8)::INTEGER AS f FROM st) p JOIN rk ON rk.i = p.i + 1)
  SELECT grp, n, fold FROM st WHERE i > 0)"""


@query("k1_group_kfold", v.with_views(v.V_FEATURES, FOLDS, body="SELECT id, grp, fold FROM v_features JOIN folds USING (grp)"))
def k1(spark, sf):
    return splits.group_kfold(_features(spark, sf).select("id", "grp"), "grp", 5)


@query("k2_group_holdout", v.with_views(v.V_FEATURES, """
g AS (SELECT DISTINCT grp FROM v_features)""", body="""
SELECT grp, row_number() OVER (ORDER BY md5(grp::VARCHAR || '#42'), grp) <= ceil((SELECT count(*) FROM g) * 0.2::DOUBLE) AS is_val FROM g"""))
def k2(spark, sf):
    return splits.group_holdout(_features(spark, sf), "grp", 0.2, 42)


@query("k3_check_label_coverage", v.with_views(v.V_FEATURES, FOLDS, """
f AS (SELECT grp, fold, CASE WHEN grp % 50 = 1 THEN 100 + grp % 500 ELSE selected_threshold END AS label FROM v_features JOIN folds USING (grp)),
l AS (SELECT label, count(DISTINCT grp) AS g, list(DISTINCT fold) AS fs FROM f GROUP BY label),
c AS (SELECT fold, CASE WHEN g > 1 THEN list_contains(fs, fold) AND len(fs) > 1 ELSE list_contains(fs, fold) END AS ok FROM l, (SELECT DISTINCT fold FROM f))""",
    body="SELECT fold, bool_and(ok) AS ok FROM c GROUP BY fold"))
def k3(spark, sf):
    folded = splits.group_kfold(_features(spark, sf).select("grp", "selected_threshold"), "grp", 5)
    label = F.when(F.col("grp") % 50 == 1, 100 + F.col("grp") % 500).otherwise(F.col("selected_threshold"))
    return splits.label_coverage(folded.withColumn("label", label), "grp", "label")


PARTS = """
ea AS (SELECT grp, folds.fold AS own, k::INTEGER AS fold FROM folds, range(0, 5) AS r(k)),
tr AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5(grp::VARCHAR || '#' || (fold + 42)), grp) AS rk, count(*) OVER (PARTITION BY fold) AS g FROM ea WHERE own <> fold),
parts AS (SELECT grp, fold, CASE WHEN rk <= ceil(g * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS role FROM tr UNION ALL SELECT grp, fold, 'test' FROM ea WHERE own = fold)"""


@query("k4_build_splits", v.with_views(v.V_FEATURES, FOLDS, PARTS, body="SELECT id AS row_key, fold, role FROM v_features JOIN parts USING (grp)"))
def k4(spark, sf):
    return splits.build_splits(_features(spark, sf), "id", "grp", 5, 0.2, 42)


@query("k5_eval_labels_ok", v.with_views(v.V_FEATURES, FOLDS, PARTS, """
r AS (SELECT fold, role, selected_threshold AS label FROM v_features JOIN parts USING (grp)),
un AS (SELECT DISTINCT fold FROM r x WHERE role = 'val' AND label NOT IN (SELECT label FROM r y WHERE y.fold = x.fold AND y.role = 'train'))""", body="""
SELECT fold, fold NOT IN (SELECT fold FROM un) AS ok FROM r WHERE role = 'val' GROUP BY fold"""))
def k5(spark, sf):
    df = _features(spark, sf)
    parts = splits.build_splits(df, "id", "grp", 5, 0.2, 42)
    rows = parts.join(df.select(F.col("id").alias("row_key"), "selected_threshold"), "row_key")
    return splits.eval_labels_by_fold(rows, "selected_threshold")


@query("k6_named_split", v.with_views(v.V_RESULTS, body="""
SELECT file::VARCHAR AS file, CASE WHEN file IN (3, 14, 159) THEN 'test' ELSE 'train' END AS role FROM v_results"""))
def k6(spark, sf):
    return splits.named_split(fx.v_results(spark, sf).select(F.col("file").cast("string").alias("file")), ["3", "14", "159"])


# ------------------------------------------------------------------ bucketed baseline

BUCKETS = ["sum_qty", "max_price", "sum_tax"]
FILLED = """
med AS (SELECT quantile_cont(sum_qty, 0.5) AS m0, quantile_cont(max_price, 0.5) AS m1, quantile_cont(sum_tax, 0.5) AS m2 FROM v_features),
fl AS (SELECT *, coalesce(sum_qty, m0) AS x0, coalesce(max_price, m1) AS x1, coalesce(sum_tax, m2) AS x2 FROM v_features, med),
ed AS (SELECT """ + ", ".join(f"list_sort(list_distinct(quantile_cont(x{i}, [0.0,0.2,0.4,0.6,0.8,1.0]))) AS e{i}" for i in range(3)) + """ FROM fl),
bn AS (SELECT *, """ + ", ".join(f"CAST(len(list_filter(e{i}[2:-2], lambda q: q <= x{i})) AS INTEGER) AS bin_{i}" for i in range(3)) + """ FROM fl, ed)"""


@query("l2_quantile_edges", v.with_views(v.V_FEATURES, body=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, unnest(range(0, 6))::INTEGER AS i, round(unnest(quantile_cont({c}, [0.0,0.2,0.4,0.6,0.8,1.0])), 6) AS edge FROM v_features" for c in BUCKETS)))
def l2(spark, sf):
    from gatelens.functions.quantiles import exact_quantiles
    q = exact_quantiles(_stored(spark, sf), [], BUCKETS, [i / 5 for i in range(6)])
    return rounded(q.select("feature", F.round(F.col("prob") * 5).cast("int").alias("i"), F.col("q").alias("edge")))


@query("l3_assign_bins", v.with_views(v.V_FEATURES, FILLED, body="SELECT id, bin_0, bin_1, bin_2 FROM bn"))
def l3(spark, sf):
    df = _stored(spark, sf, "precision", "backend")
    return BucketBaseline(BUCKETS).fit_bins(df).assign(df).select("id", "bin_0", "bin_1", "bin_2")


@query("l4_normalize_mode", """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'double' WHEN 1 THEN 'single' WHEN 2 THEN 'double' WHEN 3 THEN 'single' ELSE
    CASE WHEN o_custkey % 3 = 0 THEN 'unknown' WHEN o_custkey % 3 = 1 THEN 'single' ELSE 'double' END END AS mode_precision,
  CASE WHEN o_orderkey % 4 = 3 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN 'GPU' ELSE 'CPU' END AS mode_device FROM orders""")
def l4(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.element_at(F.array(*[F.lit(x) for x in (" Double ", "FP32", "float64", "single precision", "half", "")]), (k % 6 + 1).cast("int"))
    device = F.when(k % 4 == 3, "tpu").when(k % 2 == 0, " NVIDIA-GPU").otherwise("Cpu")
    df = fx.table(spark, sf, "orders").select(k.alias("id"), text.alias("precision"), device.alias("backend"),
                                              F.when(c % 3 != 0, (c % 3 - 1).cast("double")).alias("is_double"))
    return normalize_mode(df).select("id", "mode_precision", "mode_device")


def _stat_levels(extra=""):
    e = f"{extra}, " if extra else ""
    levels = [("bucket", "precision_, backend, bin_0, bin_1, bin_2", "precision_, backend, bin_0, bin_1, bin_2"),
              ("mode", "precision_, backend, -1, -1, -1", "precision_, backend"), ("global", "'*', '*', -1, -1, -1", "")]
    out = []
    for name, shown, grp in levels:
        keys = ", ".join(x for x in (extra, grp) if x)
        cols = [f"{c} AS {a}" for c, a in zip(shown.split(", "), ("mode_precision", "mode_device", "bin_0", "bin_1", "bin_2"))]
        by = f"GROUP BY {keys}" if keys else ""
        cnt = f"(SELECT {keys + ', ' if keys else ''}selected_threshold::INTEGER AS thr, count(*) AS c FROM bn GROUP BY {keys + ', ' if keys else ''}thr)"
        maj = f"SELECT {e}{', '.join(cols)}, CAST(sum(c) AS BIGINT) AS n, CAST(arg_max(thr, c * 10000 - thr) AS INTEGER) AS majority_threshold FROM {cnt} {by}"
        med = f"SELECT {e}{', '.join(cols)}, quantile_cont(ln(forward_wall_s), 0.5) AS med FROM bn WHERE forward_wall_s > 0 {by}"
        on = ", ".join(x for x in (extra, "mode_precision, mode_device, bin_0, bin_1, bin_2") if x)
        out.append(f"SELECT '{name}' AS level, * FROM ({maj}) LEFT JOIN ({med}) USING ({on})")
    return " UNION ALL ".join(out)


ST = "st AS (" + _stat_levels() + ")"


@query("l5_bucket_fit", v.with_views(v.V_FEATURES, FILLED, ST, body="""
SELECT level, mode_precision, mode_device, bin_0, bin_1, bin_2, n, majority_threshold, round(med, 6) AS median_log_runtime FROM st"""))
def l5(spark, sf):
    df = _stored(spark, sf, "precision", "backend")
    model = BucketBaseline(BUCKETS).fit_bins(df)
    return rounded(model.statistics(model.assign(df)))


@query("l6_bucket_predict", v.with_views(v.V_FEATURES, FILLED, ST, body="""
SELECT id, coalesce(b.majority_threshold, m.majority_threshold, g.majority_threshold) AS predicted_threshold_min,
  round(exp(coalesce(b.med, m.med, g.med)), 6) AS predicted_forward_wall_s
FROM bn LEFT JOIN st b ON b.level = 'bucket' AND b.mode_precision = bn.precision_ AND b.mode_device = bn.backend AND b.bin_0 = bn.bin_0 AND b.bin_1 = bn.bin_1 AND b.bin_2 = bn.bin_2
LEFT JOIN st m ON m.level = 'mode' AND m.mode_precision = bn.precision_ AND m.mode_device = bn.backend LEFT JOIN st g ON g.level = 'global'"""))
def l6(spark, sf):
    df = _stored(spark, sf, "precision", "backend")
    predicted = BucketBaseline(BUCKETS).fit(df).predict(df)
    return rounded(predicted.select("id", "predicted_threshold_min", "predicted_forward_wall_s"))


FST = "st AS (" + _stat_levels("fold") + ")"


FOLD_BINS = """
tr AS (SELECT v_features.*, k::INTEGER AS fold FROM v_features JOIN folds f USING (grp), range(-1, 5) AS r(k) WHERE k = -1 OR f.fold <> k),
med AS (SELECT fold, quantile_cont(sum_qty, 0.5) AS m0, quantile_cont(max_price, 0.5) AS m1, quantile_cont(sum_tax, 0.5) AS m2 FROM tr GROUP BY fold),
fl AS (SELECT tr.*, coalesce(sum_qty, m0) AS x0, coalesce(max_price, m1) AS x1, coalesce(sum_tax, m2) AS x2 FROM tr JOIN med USING (fold)),
ed AS (SELECT fold, """ + ", ".join(f"list_sort(list_distinct(quantile_cont(x{i}, [0.0,0.2,0.4,0.6,0.8,1.0]))) AS e{i}" for i in range(3)) + """ FROM fl GROUP BY fold),
bn AS (SELECT fl.*, """ + ", ".join(f"CAST(len(list_filter(e{i}[2:-2], lambda q: q <= x{i})) AS INTEGER) AS bin_{i}" for i in range(3)) + """ FROM fl JOIN ed USING (fold))"""


@query("m25_baseline_folds", v.with_views(v.V_FEATURES, FOLDS, FOLD_BINS, FST, body="""
SELECT fold, level, mode_precision, mode_device, bin_0, bin_1, bin_2, n, majority_threshold, round(med, 6) AS median_log_runtime FROM st"""))
def m25_baseline(spark, sf):
    """The baseline of every fold, fitted on its train part alone, and (fold -1) of all rows."""
    folded = cut(splits.group_kfold(_stored(spark, sf, "precision", "backend", "grp"), "grp", 5))
    return rounded(FoldedBaseline(BUCKETS).fit_folds(folded.withColumnRenamed("fold", "own"), "own", list(range(5))).tables)


TEST_BINS = """
tb AS (SELECT y.*, f.fold, """ + ", ".join(f"CAST(len(list_filter(e{i}[2:-2], lambda q: q <= coalesce({c}, m{i}))) AS INTEGER) AS bin_{i}" for i, c in enumerate(BUCKETS)) + """
  FROM v_features y JOIN folds f USING (grp) JOIN med ON med.fold = f.fold JOIN ed ON ed.fold = f.fold),
base AS (SELECT tb.id, tb.fold, tb.selected_threshold, tb.forward_wall_s, coalesce(b.majority_threshold, m.majority_threshold, g.majority_threshold) AS base_threshold,
    exp(coalesce(b.med, m.med, g.med)) AS base_s
  FROM tb LEFT JOIN st b ON b.level = 'bucket' AND b.fold = tb.fold AND b.mode_precision = precision_ AND b.mode_device = backend AND b.bin_0 = tb.bin_0 AND b.bin_1 = tb.bin_1 AND b.bin_2 = tb.bin_2
  LEFT JOIN st m ON m.level = 'mode' AND m.fold = tb.fold AND m.mode_precision = precision_ AND m.mode_device = backend LEFT JOIN st g ON g.level = 'global' AND g.fold = tb.fold)"""
#: Views up to ``base``: the baseline's out-of-fold predictions.
BASELINE = (v.V_FEATURES, FOLDS, FOLD_BINS, FST, TEST_BINS)


def baseline_out_of_fold(folded, folds=range(5)):
    """Rows of ``folds`` with their own fold as ``fold``, plus the predictions of the baseline fitted on all other folds."""
    fitted = FoldedBaseline(BUCKETS).fit_folds(folded.withColumnRenamed("fold", "own"), "own", list(folds), whole=False)
    plain = BucketBaseline(BUCKETS, tables=cut(fitted.tables))
    return plain.predict(fitted.assign(folded.where(F.col("fold").isin(list(folds)))), ["fold"])


@query("m25_baseline_out_of_fold", v.with_views(*BASELINE, body="""
SELECT id, fold, base_threshold AS predicted_threshold_min, round(base_s, 6) AS predicted_forward_wall_s FROM base"""))
def m25_out_of_fold(spark, sf):
    folded = cut(splits.group_kfold(_stored(spark, sf, "precision", "backend", "grp"), "grp", 5))
    return rounded(baseline_out_of_fold(folded).select("id", "fold", "predicted_threshold_min", "predicted_forward_wall_s"))
