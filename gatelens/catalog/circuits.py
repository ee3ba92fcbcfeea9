"""Circuit text, gate mix, cuts, spans, depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import fixtures as fx
from gatelens.catalog import query
from gatelens.catalog import sqlviews as v
from gatelens.catalog.common import rounded
from gatelens.constants import CLIFFORD, COUNTED, NON_CLIFFORD, PARAMETERIZED, THREE_QUBIT, TWO_QUBIT
from gatelens.operators import cuts, gatemix, qasm

# ------------------------------------------------------------------ text to relations

STATEMENTS = """
stmts AS (
  SELECT file, 4 AS line_no, 'qreg a[5];' AS stmt FROM v_args
  UNION ALL SELECT file, 5, 'qreg b [3];' FROM v_args
  UNION ALL SELECT file, 6, 'creg c[' || line || '];' FROM v_args
  UNION ALL SELECT file, 8, name || CASE WHEN args <> '' THEN '(' || args || ')' ELSE '' END || ' ' || ops || ' ;' FROM v_args
  UNION ALL SELECT file, 9, 'h ' || oy || ';' FROM v_args
  UNION ALL SELECT file, 10, 'barrier a;' FROM v_args
  UNION ALL SELECT file, 11, 'swap ' || ox || ',' || oz || ';' FROM v_args
  UNION ALL SELECT file, 12, 'measure ' || ox || ' -> c[0];' FROM v_args
  UNION ALL SELECT file, 13, 'opaque thing;' FROM v_args)"""


def _summary(stmts):
    return stmts.groupBy("stmt").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"),
                                     F.max("line_no").alias("last_line"), F.min("file").alias("first_file"),
                                     F.max("file").alias("last_file"))


SUMMARY = """SELECT stmt, count(*) AS n, CAST(min(line_no) AS INTEGER) AS first_line,
  CAST(max(line_no) AS INTEGER) AS last_line, min(file) AS first_file, max(file) AS last_file FROM stmts """


@query("b1_statements", v.with_views(v.V_LINES, STATEMENTS, body=SUMMARY + "GROUP BY stmt"))
def b1(spark, sf):
    return _summary(qasm.statements(fx.v_texts(spark, sf)))


@query("b2_registers", v.with_views(v.V_LINES, body="""
SELECT file, 'qreg' AS kind, 'a' AS name, 5 AS size, 1 AS decl_no FROM lines
UNION ALL SELECT file, 'qreg', 'b', 3, 2 FROM lines UNION ALL SELECT file, 'creg', 'c', line, 1 FROM lines"""))
def b2(spark, sf):
    return qasm.registers(qasm.statements(fx.v_texts(spark, sf)))


@query("b3_drop_nonunitary", v.with_views(v.V_LINES, STATEMENTS, body=SUMMARY + "WHERE line_no NOT IN (10, 12) GROUP BY stmt"))
def b3(spark, sf):
    return _summary(qasm.drop_nonunitary(qasm.statements(fx.v_texts(spark, sf))))


RAW = """
raw AS (
  SELECT file, 8 AS line_no, name, args, ops, qubits, line, radians FROM v_args
  UNION ALL SELECT file, 9, 'h', '', oy, [y], 0, NULL FROM v_args
  UNION ALL SELECT file, 11, 'swap', '', ox || ',' || oz, [x, z], 0, NULL FROM v_args)"""


@query("b4_gates_raw", v.with_views(v.V_LINES, RAW, body="""
SELECT file, line_no, name, args, CAST(len(qubits) AS INTEGER) AS n_operands FROM raw"""))
def b4(spark, sf):
    raw = qasm.gates_raw(qasm.statements(fx.v_texts(spark, sf)))
    return raw.select("file", "line_no", "name", "args", F.size("operands").alias("n_operands"))


@query("b5_operands", v.with_views(v.V_LINES, RAW, body="""
SELECT file, line_no, list_aggregate(list_transform(qubits, lambda q: CASE WHEN q < 5 THEN 'a:' || q ELSE 'b:' || (q - 5) END), 'string_agg', ' ') AS operands
FROM raw"""))
def b5(spark, sf):
    raw = qasm.gates_raw(qasm.statements(fx.v_texts(spark, sf)))
    text = F.transform("operands", lambda o: F.concat_ws(":", o["reg"], o["idx"].cast("string")))
    return raw.select("file", "line_no", F.array_join(text, " ").alias("operands"))


@query("b6_global_qubits", v.with_views(v.V_LINES, RAW, body="""
SELECT file, line_no AS seq, name, list_aggregate(qubits, 'string_agg', ' ') AS qubits FROM raw"""))
def b6(spark, sf):
    g = qasm.gates(fx.v_texts(spark, sf))
    return g.select("file", "seq", "name", F.array_join(F.transform("qubits", lambda q: q.cast("string")), " ").alias("qubits"))


@query("b6_global_qubits_joined", v.with_views(v.V_LINES, RAW, body="""
SELECT file, line_no AS seq, name, list_aggregate(qubits, 'string_agg', ' ') AS qubits FROM raw"""))
def b6_joined(spark, sf):
    stmts = qasm.statements(fx.v_texts(spark, sf))
    g = qasm.global_qubits(qasm.gates_raw(stmts), qasm.declarations(stmts))
    return g.select("file", "seq", "name", F.array_join(F.transform("qubits", lambda q: q.cast("string")), " ").alias("qubits"))


@query("b7_eval_params", v.with_views(v.V_LINES, RAW, body="""
SELECT file, line_no AS seq, CAST(CASE WHEN line IN (3, 5) THEN 1 WHEN line = 6 THEN 3 ELSE 0 END AS INTEGER) AS n_params,
  round(CASE WHEN line IN (3, 5, 6) THEN radians END, 9) AS first_param,
  round(CASE WHEN line = 6 THEN -pi() / 2 END, 9) AS second_param, CASE WHEN line = 6 THEN 1.5e-08::DOUBLE END AS third_param
FROM raw"""))
def b7(spark, sf):
    g = qasm.gates(fx.v_texts(spark, sf))
    at = lambda i: F.get("params", F.lit(i))
    return g.select("file", "seq", F.size("params").alias("n_params"), F.round(at(0), 9).alias("first_param"),
                    F.round(at(1), 9).alias("second_param"), at(2).alias("third_param"))


def _names(names):
    return ", ".join(f"'{n}'" for n in names)


@query("b8_tag_arity", v.with_views(v.V_LINES, RAW, body=f"""
SELECT name, name IN ({_names(TWO_QUBIT)}) AS is_2q, name IN ({_names(THREE_QUBIT)}) AS is_3q,
  name IN ({_names(PARAMETERIZED)}) AS is_param, count(*) AS n FROM raw GROUP BY 1"""))
def b8(spark, sf):
    tagged = qasm.tag_arity(qasm.gates_raw(qasm.statements(fx.v_texts(spark, sf))))
    return tagged.groupBy("name", "is_2q", "is_3q", "is_param").agg(F.count(F.lit(1)).alias("n"))


@query("b9_circuit_header", v.with_views(v.V_LINES, body="""
SELECT file, 8::BIGINT AS n_qubits, line::BIGINT AS n_cbits, 2::BIGINT AS n_qregs, 1::BIGINT AS n_cregs FROM lines"""))
def b9(spark, sf):
    return qasm.headers(fx.v_texts(spark, sf))


@query("b9_circuit_header_joined", v.with_views(v.V_LINES, body="""
SELECT file, 8::BIGINT AS n_qubits, line::BIGINT AS n_cbits, 2::BIGINT AS n_qregs, 1::BIGINT AS n_cregs FROM lines"""))
def b9_joined(spark, sf):
    texts = fx.v_texts(spark, sf)
    return qasm.circuit_header(texts, qasm.registers(qasm.statements(texts)))


# ------------------------------------------------------------------ gate mix

def _counts(spark, sf):
    return gatemix.name_counts(fx.v_gates(spark, sf, with_seq=False))


def _count(names):
    return f"CAST(count(*) FILTER (WHERE name IN ({_names(names)})) AS DOUBLE)"


@query("c1_gate_counts", v.with_views(v.V_GATES, body="SELECT file, " + ", ".join(
    f"{_count([g])} AS gate_{g}_count, round({_count([g])} / greatest(count(*), 1), 6) AS gate_{g}_frac" for g in COUNTED)
    + " FROM v_gates GROUP BY file"))
def c1(spark, sf):
    return rounded(gatemix.gate_counts(_counts(spark, sf)))


@query("c2_gate_class_totals", v.with_views(v.V_GATES, body=f"""
SELECT file, {_count(['h', 'rz', 'u'])} AS n_1q_gates, {_count(TWO_QUBIT)} AS n_2q_gates, {_count(THREE_QUBIT)} AS n_3q_gates,
  {_count(PARAMETERIZED)} AS n_parameterized_gates, round({_count(TWO_QUBIT)} / count(*), 6) AS frac_2q,
  round({_count(THREE_QUBIT)} / count(*), 6) AS frac_3q, round({_count(PARAMETERIZED)} / count(*), 6) AS frac_parameterized,
  CAST(count(DISTINCT name) AS DOUBLE) AS n_distinct_gate_types, CAST(count(*) AS DOUBLE) AS total_gates
FROM v_gates GROUP BY file"""))
def c2(spark, sf):
    return rounded(gatemix.gate_class_totals(_counts(spark, sf)))


@query("c3_clifford_split", v.with_views(v.V_GATES, body=f"""
SELECT file, {_count(CLIFFORD)} AS n_clifford_gates, {_count(NON_CLIFFORD)} AS n_nonclifford_gates,
  round({_count(CLIFFORD)} / count(*), 6) AS frac_clifford, round({_count(NON_CLIFFORD)} / count(*), 6) AS frac_nonclifford,
  round({_count(CLIFFORD)} / greatest({_count(NON_CLIFFORD)}, 1), 6) AS clifford_to_nonclifford_ratio
FROM v_gates GROUP BY file"""))
def c3(spark, sf):
    return rounded(gatemix.clifford_split(_counts(spark, sf)))


ANGLE = "angles AS (SELECT file, abs(param) AS x, round_even(abs(param), 8) AS r FROM v_gates WHERE param IS NOT NULL)"


@query("c4_param_moments", v.with_views(v.V_GATES, ANGLE, body="""
SELECT file, round(coalesce(avg(x), 0), 6) AS param_mean, round(coalesce(stddev_pop(x), 0), 6) AS param_std,
  round(coalesce(min(x), 0), 6) AS param_min, round(coalesce(max(x), 0), 6) AS param_max
FROM (SELECT DISTINCT file FROM v_gates) LEFT JOIN angles USING (file) GROUP BY file"""))
def c4(spark, sf):
    g = fx.v_gates(spark, sf, with_seq=False)
    return rounded(gatemix.param_moments(gatemix.angle_counts(g), fx.v_circuits(spark, sf)))


@query("c5_param_entropy", v.with_views(v.V_GATES, ANGLE, """
lims AS (SELECT file, least(20, greatest(count(DISTINCT r), 2)) AS bins, min(x) AS mn, max(x) AS mx FROM angles GROUP BY file),
lim AS (SELECT file, bins, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM lims),
hist AS (SELECT file, least(floor((x - lo) / (hi - lo) * bins), bins - 1) AS slot, count(*) AS c FROM angles JOIN lim USING (file) GROUP BY 1, 2),
p AS (SELECT file, c / sum(c) OVER (PARTITION BY file) AS p FROM hist)""", body="""
SELECT file, round(coalesce(abs(-sum(p * log2(p))), 0), 6) AS param_entropy
FROM (SELECT DISTINCT file FROM v_gates) LEFT JOIN p USING (file) GROUP BY file"""))
def c5(spark, sf):
    g = fx.v_gates(spark, sf, with_seq=False)
    return rounded(gatemix.param_entropy(gatemix.angle_counts(g), fx.v_circuits(spark, sf)))


@query("c6_param_frequency", v.with_views(v.V_GATES, ANGLE, """
freq AS (SELECT file, r, count(*) AS c FROM angles GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY c DESC, r) AS rk FROM freq),
s AS (SELECT file, count(*)::DOUBLE AS k, sum(c)::DOUBLE AS n, max(c)::DOUBLE AS m, sum(c) FILTER (WHERE rk <= 3)::DOUBLE AS t FROM top GROUP BY file)""",
    body="""
SELECT file, coalesce(k, 0) AS param_n_unique, round(coalesce(k / n, 0), 6) AS param_unique_ratio,
  round(coalesce(1 - k / n, 0), 6) AS param_reuse_rate, round(coalesce(m / n, 0), 6) AS param_mode_frac,
  round(coalesce(t / n, 0), 6) AS param_top3_frac
FROM (SELECT DISTINCT file FROM v_gates) LEFT JOIN s USING (file)"""))
def c6(spark, sf):
    g = fx.v_gates(spark, sf, with_seq=False)
    return rounded(gatemix.param_frequency(gatemix.angle_counts(g), fx.v_circuits(spark, sf)))


@query("c7_cross_features", v.with_views(v.V_GATES, v.INTER, v.SPINE, """
cut AS (SELECT file, cut, count(*) AS p FROM inter, range(1, 64) AS r(cut) WHERE least(a, b) < cut AND cut <= greatest(a, b) GROUP BY 1, 2),
mx AS (SELECT file, max(p)::DOUBLE AS mp FROM cut GROUP BY file),
g AS (SELECT file, count(*)::DOUBLE AS t, count(*) FILTER (WHERE name IN ('cx','cz','cp','ccx'))::DOUBLE AS e FROM v_gates GROUP BY file)""",
    body="""
SELECT file, round(t / 64, 6) AS gates_per_qubit, round(e / 64, 6) AS entangling_gates_per_qubit,
  round(coalesce(mp, 0) / 64, 6) AS cut_pressure_per_qubit, round(ln(1 + t), 6) AS log_total_gates,
  round(ln(65), 6) AS log_n_qubits, round(ln(1 + coalesce(mp, 0)), 6) AS log_max_cut_pressure
FROM g LEFT JOIN mx USING (file)"""))
def c7(spark, sf):
    g = fx.v_gates(spark, sf, with_seq=False)
    counts, spine = gatemix.name_counts(g), fx.v_circuits(spark, sf)
    totals = gatemix.gate_class_totals(counts).withColumn("n_entangling_gates", F.col("n_2q_gates") + F.col("n_3q_gates"))
    pressure = cuts.cut_pressure(cuts.interaction_graph(cuts.interactions(g)), spine)
    f = gatemix.cross_features(gatemix.join_on_file([spine, totals, pressure]))
    return rounded(f.select("file", "gates_per_qubit", "entangling_gates_per_qubit", "cut_pressure_per_qubit",
                            "log_total_gates", "log_n_qubits", "log_max_cut_pressure"))


# ------------------------------------------------------------------ interactions, cuts, spans, runs

def _edges(spark, sf):
    return cuts.interaction_graph(cuts.interactions(fx.v_gates(spark, sf, with_seq=False)))


@query("d1_interactions", v.with_views(v.V_GATES, v.INTER, body="SELECT file, seq, a, b FROM inter"))
def d1(spark, sf):
    return cuts.interactions(fx.v_gates(spark, sf))


@query("d2_interaction_graph", v.with_views(v.V_GATES, v.INTER, v.EDGES, body="SELECT * FROM edges"))
def d2(spark, sf):
    return _edges(spark, sf)


PRESSURE = """
cutrows AS (SELECT file, unnest(range(1, n_qubits)) AS cut FROM spine),
crossing AS (SELECT file, unnest(range(least(a, b) + 1, greatest(a, b) + 1)) AS cut FROM inter),
profile AS (SELECT c.file, c.cut, coalesce(x.n, 0) AS p FROM cutrows c
  LEFT JOIN (SELECT file, cut, count(*) AS n FROM crossing GROUP BY 1, 2) x USING (file, cut))"""


@query("d3_cut_pressure", v.with_views(v.V_GATES, v.INTER, v.SPINE, PRESSURE, """
share AS (SELECT file, p, p / nullif(sum(p) OVER (PARTITION BY file), 0) AS q FROM profile)""", body="""
SELECT file, max(p)::DOUBLE AS max_cut_pressure, round(avg(p), 6) AS mean_cut_pressure, round(stddev_pop(p), 6) AS std_cut_pressure,
  sum(p)::DOUBLE AS sum_cut_pressure, round(coalesce(-sum(CASE WHEN q > 0 THEN q * log2(q) END), 0), 6) AS cut_pressure_entropy,
  (count(*) FILTER (WHERE p > 0))::DOUBLE AS n_active_cuts, round((count(*) FILTER (WHERE p > 0)) / count(*), 6) AS cut_pressure_frac_active
FROM share GROUP BY file"""))
def d3(spark, sf):
    return rounded(cuts.cut_pressure(_edges(spark, sf), fx.v_circuits(spark, sf)))


@query("d4_linear_cut_metrics", v.with_views(v.V_GATES, v.INTER, v.EDGES, v.SPINE, PRESSURE, """
ecross AS (SELECT file, unnest(range(u + 1, v + 1)) AS cut FROM edges),
e AS (SELECT file, max(n) AS m FROM (SELECT file, cut, count(*) AS n FROM ecross GROUP BY 1, 2) GROUP BY 1)""", body="""
SELECT file, coalesce(e.m, 0)::DOUBLE AS edge_cutwidth_natural, max(p)::DOUBLE AS entangling_cutwidth_natural
FROM profile LEFT JOIN e USING (file) GROUP BY file, e.m"""))
def d4(spark, sf):
    return cuts.linear_cut_metrics(_edges(spark, sf), fx.v_circuits(spark, sf))


@query("d5_gate_span", v.with_views(v.V_GATES, v.INTER, v.SPINE, """
s AS (SELECT file, abs(a - b)::DOUBLE AS s, abs(a - b) / 63.0::DOUBLE AS t FROM inter)""", body="""
SELECT file, coalesce(max(s), 0) AS max_gate_span, round(coalesce(avg(s), 0), 6) AS mean_gate_span, round(coalesce(stddev_pop(s), 0), 6) AS std_gate_span,
  round(quantile_cont(s, 0.25), 6) AS span_p25, round(quantile_cont(s, 0.5), 6) AS span_p50, round(quantile_cont(s, 0.75), 6) AS span_p75,
  round(quantile_cont(s, 0.9), 6) AS span_p90, round(avg(t), 6) AS mean_gate_span_norm, round(stddev_pop(t), 6) AS std_gate_span_norm,
  round(quantile_cont(t, 0.9), 6) AS span_q90_norm, round(quantile_cont(t, 0.25), 6) AS span_p25_norm, round(quantile_cont(t, 0.5), 6) AS span_p50_norm,
  round(quantile_cont(t, 0.75), 6) AS span_p75_norm, round(quantile_cont(t, 0.9), 6) AS span_p90_norm,
  round(coalesce(avg(CASE WHEN s = 1 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END), 1), 6) AS frac_nearest_neighbor,
  round(coalesce(avg(CASE WHEN s > 16 THEN 1.0 WHEN s IS NOT NULL THEN 0.0 END), 0), 6) AS frac_long_range,
  round(avg(s * s), 6) AS connectivity_strain, round(avg(t * t), 6) AS connectivity_strain_norm
FROM spine LEFT JOIN s USING (file) GROUP BY file"""))
def d5(spark, sf):
    return rounded(cuts.gate_span(_edges(spark, sf), fx.v_circuits(spark, sf)))


@query("d8_entangling_runs", v.with_views(v.V_GATES, """
f AS (SELECT file, seq, CASE WHEN name IN ('cx','cz','cp','ccx') THEN 1 ELSE 0 END AS e FROM v_gates),
st AS (SELECT *, CASE WHEN e = 1 AND coalesce(lag(e) OVER (PARTITION BY file ORDER BY seq), 0) = 0 THEN 1 ELSE 0 END AS starts FROM f),
isl AS (SELECT *, sum(starts) OVER (PARTITION BY file ORDER BY seq) AS island FROM st),
runs AS (SELECT file, island, count(*) AS n FROM isl WHERE e = 1 GROUP BY 1, 2),
r AS (SELECT file, max(n)::DOUBLE AS mx, avg(n) AS mean, stddev_pop(n) AS sd FROM runs GROUP BY file)""", body="""
SELECT file, sum(e)::DOUBLE AS n_entangling_gates, sum(starts)::DOUBLE AS n_entangling_layers, round(sum(e) / count(*), 6) AS entangling_gate_ratio,
  round(coalesce(sum(e) / nullif(sum(starts), 0), 0), 6) AS entangling_gates_per_layer, coalesce(max(mx), 0) AS entangling_run_max,
  round(coalesce(max(mean), 0), 6) AS entangling_run_mean, round(coalesce(max(sd), 0), 6) AS entangling_run_std
FROM st LEFT JOIN r USING (file) GROUP BY file"""))
def d8(spark, sf):
    return rounded(cuts.entangling_runs(fx.v_gates(spark, sf), dense=True))
