"""Readers over table data, the feature frame, imputation, targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from gatelens import fixtures as fx
from gatelens.catalog import ORACLES, query
from gatelens.catalog import sqlviews as v
from gatelens.catalog.common import rounded
from gatelens.catalog.graphs import E6_SQL
from gatelens.functions.lineage import cut
from gatelens.operators import frame, sweep
from gatelens.sources import benchmark, circuits


def _orders(spark, sf):
    return fx.table(spark, sf, "orders")


@query("a2_circuit_metadata", """
SELECT o_orderkey::VARCHAR AS file, o_orderpriority AS family, (o_custkey % 131)::INTEGER AS n_qubits, o_orderstatus AS source_name FROM orders""")
def a2(spark, sf):
    source = F.struct(F.col("o_orderstatus").alias("name"), F.lit("u").alias("url"), F.lit("n").alias("notes"))
    nested = _orders(spark, sf).select(F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("file"), F.col("o_orderpriority").alias("family"),
        (F.col("o_custkey") % 131).cast("int").alias("n_qubits"), source.alias("source"))).alias("doc"))
    return benchmark.circuit_metadata(nested.select(F.from_json("doc", benchmark.CIRCUIT).alias("c")).select("c.*"))


@query("a3_missing_texts", """
SELECT DISTINCT o_orderkey + 100 AS file FROM orders WHERE o_orderkey + 100 NOT IN (SELECT l_orderkey FROM lineitem)""")
def a3(spark, sf):
    texts = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"))
    manifest = _orders(spark, sf).select((F.col("o_orderkey") + 100).alias("file"))
    return circuits.match_manifest(texts, manifest)[1]


ID_MAP = """
e AS (SELECT CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 't' || o_custkey END AS id, CASE WHEN o_orderkey % 5 <> 0 THEN 'c' || o_orderkey END AS qasm_file, o_orderkey AS pos FROM orders)"""


def _id_map(spark, sf):
    o = _orders(spark, sf)
    return benchmark.id_map(o.select(
        F.when(F.col("o_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("t"), F.col("o_custkey").cast("string"))).alias("id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))).alias("qasm_file"),
        F.col("o_orderkey").alias("pos")))


# ------------------------------------------------------------------ frame

def _features(spark, sf):
    return fx.v_features(spark, sf)


@query("h1_attach_circuit_features", v.with_views(v.V_RESULTS, v.V_GATES, v.INTER, body="""
SELECT r.file, r.family, g.n::DOUBLE AS n_gates FROM v_results r LEFT JOIN (SELECT l_orderkey AS file, count(*) AS n FROM lineitem GROUP BY 1) g USING (file)"""))
def h1(spark, sf):
    features = fx.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.count(F.lit(1)).cast("double").alias("n_gates"))
    return frame.attach_circuit_features(fx.v_results(spark, sf).select("file", "family"), features)


@query("h2_config_flags", v.with_views(v.V_RESULTS, body="""
SELECT file, (backend = 'GPU')::INTEGER::DOUBLE AS is_gpu, (precision_ = 'double')::INTEGER::DOUBLE AS is_double FROM v_results"""))
def h2(spark, sf):
    return frame.config_flags(fx.v_results(spark, sf)).select("file", "is_gpu", "is_double")


@query("h3_log_targets", v.with_views(v.V_RESULTS, body="""
SELECT file, round(ln(1 + forward_wall_s), 6) AS log_forward_wall_s, round(ln(1 + coalesce(state_setup_wall_s, 0)), 6) AS log_setup_s FROM v_results"""))
def h3(spark, sf):
    r = fx.v_results(spark, sf).withColumnRenamed("state_setup_wall_s", "estimated_setup_s")
    return rounded(frame.log_targets(r).select("file", "log_forward_wall_s", "log_setup_s"))


@query("h4_holdout_frame", v.with_views(ID_MAP, """
m AS (SELECT id, arg_max(qasm_file, pos) AS qasm_file FROM e WHERE id <> '' AND qasm_file <> '' GROUP BY id)""", body="""
SELECT 't' || o_custkey AS task_id, o_orderkey AS task_no, m.qasm_file AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'CPU' ELSE 'GPU' END AS backend, f.o_totalprice AS size
FROM orders o JOIN m ON m.id = 't' || o.o_custkey JOIN (SELECT 'c' || o_orderkey AS file, o_totalprice FROM orders) f ON f.file = m.qasm_file"""))
def h4(spark, sf):
    o = _orders(spark, sf)
    tasks = o.select(F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("task_id"), F.col("o_orderkey").alias("task_no"),
                     F.when(F.col("o_orderkey") % 2 == 0, "CPU").otherwise("GPU").alias("processor"))
    features = o.select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("file"), F.col("o_totalprice").alias("size"))
    return frame.holdout_frame(tasks, _id_map(spark, sf), features, allow_missing_ids=True).select("task_id", "task_no", "file", "backend", "size")


ALL = ["n_lines", "sum_qty", "avg_discount", "max_price", "sum_tax", "blend", "constant"]


@query("h5_feature_columns", v.with_views(v.V_FEATURES, body=f"SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in ALL)} FROM v_features"))
def h5(spark, sf):
    df = _features(spark, sf)
    return rounded(df.select("id", *frame.feature_columns([c for c in df.columns if c not in ("id", "grp")])))


@query("h6_drop_constant", v.with_views(v.V_FEATURES, body="SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(stddev_samp({c}), 6) AS std FROM v_features" for c in ALL) + ") WHERE std > 1e-10"))
def h6(spark, sf):
    return rounded(frame.column_spread(_features(spark, sf), ALL).where("n > 0 AND std > 1e-10"))


@query("h7_align_columns", v.with_views(v.V_FEATURES, body="""
SELECT id, round(blend, 6) AS blend, 0.0::DOUBLE AS unknown_column, round(sum_qty, 6) AS sum_qty, NULL::DOUBLE AS backend,
  (backend = 'GPU')::INTEGER::DOUBLE AS is_gpu, (precision_ = 'double')::INTEGER::DOUBLE AS is_double FROM v_features"""))
def h7(spark, sf):
    return rounded(frame.align_columns(_features(spark, sf), ["blend", "unknown_column", "sum_qty", "backend"], ["id"]))


GAPS = """
g AS (SELECT id, sum_tax, CASE WHEN id % 9 = 0 THEN NULL ELSE max_price END AS max_price FROM v_features),
m AS (SELECT quantile_cont(sum_tax, 0.5) AS a, quantile_cont(max_price, 0.5) AS b FROM g)"""


def _gaps(spark, sf):
    return _features(spark, sf).select("id", "sum_tax", F.when(F.col("id") % 9 == 0, float("inf")).otherwise(F.col("max_price")).alias("max_price"))


@query("h8_impute", v.with_views(v.V_FEATURES, GAPS, body="""
SELECT id, round(coalesce(sum_tax, a), 6) AS sum_tax, round(coalesce(max_price, b), 6) AS max_price FROM g, m"""))
def h8(spark, sf):
    g = cut(_gaps(spark, sf))
    return rounded(frame.impute(g, frame.fit_fill(g, ["sum_tax", "max_price"])))


@query("h8_impute_mean", v.with_views(v.V_FEATURES, GAPS, body="""
SELECT id, round(coalesce(sum_tax, (SELECT avg(sum_tax) FROM g)), 6) AS sum_tax, round(coalesce(max_price, (SELECT avg(max_price) FROM g)), 6) AS max_price FROM g"""))
def h8_mean(spark, sf):
    g = _gaps(spark, sf)
    return rounded(frame.impute(g, frame.fit_fill(g, ["sum_tax", "max_price"], "mean")))


@query("h9_labelled_targets", v.with_views(v.V_FEATURES, body="""
SELECT id, selected_threshold, round(forward_wall_s, 6) AS forward_wall_s, round(estimated_setup_s, 6) AS estimated_setup_s,
  round(estimated_per_shot_s, 6) AS estimated_per_shot_s FROM v_features WHERE id % 3 <> 0"""))
def h9(spark, sf):
    df = _features(spark, sf).withColumn("selected_threshold", F.when(F.col("id") % 3 != 0, F.col("selected_threshold")))
    return rounded(frame.targets(frame.labelled_only(df)))


@query("h10_expand_rungs", v.with_views(v.V_SWEEP, body="""
SELECT file, backend, precision_ AS precision, threshold AS rung, log2(threshold) AS log2_rung, round(fid, 6) AS y FROM kept"""))
def h10(spark, sf):
    wide = sweep.pivot_sweep(sweep.explode_sweep(fx.v_sweep(spark, sf)))
    return rounded(frame.expand_rungs(wide, frame.CURVE_COLUMNS, sweep.KEY))


@query("h11_threshold_feature", v.with_views(v.V_FEATURES, body="""
SELECT id, log2(least(greatest(selected_threshold * (id % 3), 1), 512)) AS thr_log2, selected_threshold * (id % 3) AS thr_raw FROM v_features"""))
def h11(spark, sf):
    df = _features(spark, sf).select("id", (F.col("selected_threshold") * (F.col("id") % 3)).alias("t"))
    return frame.threshold_feature(df, "t", "both").drop("t")


@query("h12_extras", v.with_views(v.V_FEATURES, body="""
SELECT id, round(blend, 6) AS blend, (backend = 'GPU')::INTEGER::DOUBLE AS is_gpu, (precision_ = 'double')::INTEGER::DOUBLE AS is_double FROM v_features"""))
def h12(spark, sf):
    df = frame.config_flags(_features(spark, sf))
    return rounded(df.select("id", *frame.with_extras(["blend"], df.columns)))


@query("h1_full_circuit_frame")
def full_frame(spark, sf):
    """All circuit features of one row per circuit, straight from gates."""
    from gatelens.plans.features import circuit_features
    header = fx.v_circuits(spark, sf).withColumns({"n_cbits": F.lit(0), "n_cregs": F.lit(0)})
    return circuit_features(fx.v_gates(spark, sf), header, dense=True)


FRAME_PARTS = ["c1_gate_counts", "c2_gate_class_totals", "c3_clifford_split", "c4_param_moments", "c5_param_entropy", "c6_param_frequency",
               "d3_cut_pressure", "d4_linear_cut_metrics", "d5_gate_span", "d7_layer_stats", "d8_entangling_runs", "e1_degree_stats",
               "e2_degree_entropy", "e3_density", "e4_components", "e5_avg_clustering", "e7_elimination_width", "e9_bandwidth_heuristic", "e9_bandwidth",
               "e10_cutwidth_heuristic", "e10_cutwidth", "e11_linear_arrangement", "e12_balanced_separator", "e13_recursive_bisection",
               "e14_cut_conductance", "e15_path_metrics", "e16_edge_weight_stats", "e17_topology_flags", "e18_arboricity_bound"]


def _frame_sql() -> str:
    """The feature queries' SQL, each over the circuits of eight qubits, joined on the circuit. Gate mix and runs have no row for a
    circuit without such gates, which counts as 0; a span without interactions stays NULL."""
    angle = "CASE WHEN l_linenumber IN (3,5,6) THEN round_even(l_discount * 100, 0) * pi() / 16 END AS param, 8 AS n_qubits"
    small = v.V_GATES_SMALL.replace("8 AS n_qubits", angle)
    # what the SQL over circuits of 64 qubits says of their width
    narrow = {"range(1, 64)": "range(1, 8)", "/ 63.0": "/ 7.0", "s > 16": "s > 2", "2016.0": "28.0", "/ 64, 6": "/ 8, 6", "u < 32": "u < 4",
              "v < 32": "v < 4", "v >= 32": "v >= 4", "64 //": "8 //", "32 //": "4 //", "range(0, 6)": "range(0, 3)"}
    parts = []
    for name in FRAME_PARTS:
        sql = ORACLES[name]
        if v.V_GATES in sql:
            sql = reduce(lambda text, k: text.replace(k, narrow[k]), narrow, sql.replace(v.V_GATES, ""))
            sql = sql.replace("WITH ", f"WITH {small}", 1)
        sql = sql.replace(v.V_GATES_SMALL, small)
        if name.startswith(("c1", "c2", "c3", "d8")):
            sql = f"SELECT file, coalesce(COLUMNS(* EXCLUDE (file)), 0) FROM (SELECT DISTINCT file FROM spine) LEFT JOIN ({sql}) USING (file)"
        parts.append(sql)
    parts.append(f"SELECT file, max(core) AS graph_degeneracy FROM ({E6_SQL}) GROUP BY file")
    joins = " ".join(f"LEFT JOIN ({sql}) p{i} USING (file)" for i, sql in enumerate(parts))
    smaller = ", ".join(f"least(graph_{m}_natural, graph_{m}_heuristic) AS graph_{m}_min" for m in ("bandwidth", "cutwidth", "linear_arrangement"))
    # clustering of eight nodes is a whole number of 1680ths: the rounded mean tells which
    return f"""
WITH {small}, {v.SPINE}, parts AS (SELECT * FROM (SELECT DISTINCT file FROM spine) {joins}),
filled AS (SELECT file, CAST(COLUMNS(* EXCLUDE (file)) AS DOUBLE) FROM parts),
wide AS (SELECT *, 8 AS n_qubits, 2 AS n_qregs, 0 AS n_cbits, 0 AS n_cregs, {smaller},
  (round(graph_avg_clustering * 1680) / 1680) / (graph_n_edges / 28 + 1e-12::DOUBLE) AS graph_clustering_over_density,
  total_gates / 8 AS gates_per_qubit, n_entangling_gates / 8 AS entangling_gates_per_qubit, max_cut_pressure / 8 AS cut_pressure_per_qubit,
  ln(1 + total_gates) AS log_total_gates, ln(9) AS log_n_qubits, ln(1 + max_cut_pressure) AS log_max_cut_pressure FROM filled)
SELECT file, round(CAST(COLUMNS(* EXCLUDE (file)) AS DOUBLE), 6) FROM wide"""


@query("h1_circuit_frame_values", _frame_sql())
def frame_values(spark, sf):
    """All numeric features of one row per circuit, with path lengths and conductance."""
    from gatelens.plans.features import circuit_features
    header = fx.v_circuits_small(spark, sf).withColumns({"n_cbits": F.lit(0), "n_cregs": F.lit(0)})
    return rounded(circuit_features(fx.v_gates_small(spark, sf), header, dense=True, expansion=True).drop("predicted_family"))
