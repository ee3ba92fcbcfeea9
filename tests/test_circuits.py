"""Golden circuits worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from gatelens.operators import cuts, depth, elimination, family, gatemix, graph, graph_search, qasm
from gatelens.plans.features import features_from_texts

HEAD = 'OPENQASM 2.0;\ninclude "qelib1.inc";\n'
TEXTS = {
    "empty": HEAD,
    "one": HEAD + "qreg q[1];\nh q[0];\nx q[0];\n",
    "ghz": HEAD + "qreg q[4];\ncreg c[4];\nh q[0];\ncx q[0],q[1];\ncx q[1],q[2];\ncx q[2],q[3];\nbarrier q;\nmeasure q -> c;\n",
    "star": HEAD + "qreg q[5];\n" + "".join(f"cx q[0],q[{i}];\n" for i in range(1, 5)),
    "k4": HEAD + "qreg q[4];\n" + "".join(f"cz q[{i}],q[{j}];\n" for i in range(4) for j in range(i + 1, 4)),
    "two_regs": HEAD + "qreg eval[3];\nqreg q[1];\ncp(pi/4) eval[2],q[0];\nry(0.927) q[0];\n",
    "ccx": HEAD + "qreg q[3];\nccx q[0],q[1],q[2];\n",
    "repeat": HEAD + "qreg q[2];\ncx q[0],q[1];\ncx q[1],q[0];\ncx q[0],q[1];\n",
    "pairs": HEAD + "qreg q[6];\ncx q[0],q[1];\ncx q[4],q[5];\n",
    "angles": HEAD + "qreg q[1];\n" + "".join(
        f"rz({a}) q[0];\n" for a in ("pi/4", "-pi/2", "3*pi/8", "-2*pi", "0.927", "2.1e-08", "7", "nonsense", "1/0", "")),
    "redeclared": HEAD + "qreg a[2];\nqreg b[3];\nqreg a[4];\ncx b[0],a[1];\n",
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(TEXTS.items()), "file string, text string").cache()


@pytest.fixture(scope="module")
def gates(texts):
    return qasm.gates(texts).cache()


@pytest.fixture(scope="module")
def spine(texts):
    return qasm.headers(texts).select("file", F.col("n_qubits").cast("int").alias("n_qubits")).cache()


@pytest.fixture(scope="module")
def edges(gates):
    return cuts.interaction_graph(cuts.interactions(gates)).cache()


def rows(df, *by):
    return {tuple(r[k] for k in by) if len(by) > 1 else r[by[0]]: r for r in df.collect()}


def test_parse_and_offsets(texts, gates):
    got = {(r.file, r.name): r.qubits for r in gates.where("file IN ('two_regs', 'ccx')").collect()}
    assert got == {("two_regs", "cp"): [2, 3], ("two_regs", "ry"): [3], ("ccx", "ccx"): [0, 1, 2]}
    stmts = qasm.statements(texts)
    joined = qasm.global_qubits(qasm.gates_raw(stmts), qasm.declarations(stmts))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(joined) == key(gates)
    # a register declared twice: sizes a=4, b=3; the last declaration of a starts after a and b
    assert {r.file: r.qubits for r in gates.where("file = 'redeclared'").collect()} == {"redeclared": [4, 8]}


def test_headers(texts):
    heads = rows(qasm.headers(texts), "file")
    assert (heads["two_regs"].n_qubits, heads["two_regs"].n_qregs, heads["ghz"].n_cbits, heads["ghz"].n_cregs) == (4, 2, 4, 1)
    assert heads["empty"].n_qubits == 0
    joined = rows(qasm.circuit_header(texts, qasm.registers(qasm.statements(texts))), "file")
    assert {f: tuple(r) for f, r in joined.items()} == {f: tuple(r) for f, r in heads.items()}


def test_angles(gates):
    values = [r.params for r in gates.where("file = 'angles'").orderBy("seq").collect()]
    want = [math.pi / 4, -math.pi / 2, 3 * math.pi / 8, -2 * math.pi, 0.927, 2.1e-08, 7.0, None, None]
    assert [p[0] for p in values[:-1]] == want
    assert values[-1] == []


def test_gate_mix(gates, spine):
    counts = gatemix.name_counts(gates)
    c = rows(gatemix.gate_counts(counts), "file")["ghz"]
    assert (c.gate_cx_count, c.gate_cx_frac, c.gate_h_count) == (3.0, 0.75, 1.0)
    t = rows(gatemix.gate_class_totals(counts), "file")
    assert (t["ccx"].n_3q_gates, t["ccx"].total_gates, t["ghz"].n_1q_gates) == (1.0, 1.0, 1.0)
    angles = gatemix.angle_counts(gates)
    freq = rows(gatemix.param_frequency(angles, spine), "file")
    assert freq["angles"].param_n_unique == 7.0 and freq["ghz"].param_n_unique == 0.0
    moments = rows(gatemix.param_moments(angles, spine), "file")["two_regs"]
    assert moments.param_mean == pytest.approx((math.pi / 4 + 0.927) / 2)
    assert moments.param_std == pytest.approx(abs(math.pi / 4 - 0.927) / 2)


def test_cuts_and_spans(edges, spine):
    c = rows(cuts.cut_pressure(edges, spine), "file")
    assert (c["ghz"].max_cut_pressure, c["ghz"].n_active_cuts, c["ghz"].cut_pressure_entropy) == (1.0, 3.0, pytest.approx(math.log2(3)))
    assert c["star"].max_cut_pressure == 4.0 and c["star"].sum_cut_pressure == 10.0
    assert c["k4"].max_cut_pressure == 4.0 and c["one"].sum_cut_pressure == 0.0
    assert c["pairs"].cut_pressure_frac_active == 0.4
    lin = rows(cuts.linear_cut_metrics(edges, spine), "file")
    assert (lin["repeat"].edge_cutwidth_natural, lin["repeat"].entangling_cutwidth_natural) == (1.0, 3.0)
    s = rows(cuts.gate_span(edges, spine), "file")
    assert s["one"].frac_nearest_neighbor == 1.0 and s["one"].span_p25 is None
    assert (s["star"].max_gate_span, s["star"].mean_gate_span, s["star"].span_p50) == (4.0, 2.5, 2.5)
    for f, r in c.items():
        if s[f].connectivity_strain is not None and f != "redeclared":  # its last qubit lies beyond the declared total
            total = s[f].mean_gate_span * {"ghz": 3, "star": 4, "k4": 6, "two_regs": 1, "ccx": 3, "repeat": 3, "pairs": 2}[f]
            assert r.sum_cut_pressure == pytest.approx(total)
        assert f == "redeclared" or lin[f].entangling_cutwidth_natural == r.max_cut_pressure


def test_runs(gates):
    r = rows(cuts.entangling_runs(gates), "file")
    assert (r["ghz"].n_entangling_layers, r["ghz"].entangling_run_max) == (1.0, 3.0)
    assert r["angles"].n_entangling_gates == 0.0 and r["angles"].entangling_run_max == 0.0


def test_layers(gates, spine):
    layers = depth.asap_layers(gates, spine)
    d = rows(depth.layer_stats(layers, spine), "file")
    assert (d["ghz"].circuit_depth, d["star"].circuit_depth, d["pairs"].circuit_depth, d["empty"].circuit_depth) == (4.0, 4.0, 1.0, 0.0)
    assert d["k4"].circuit_depth == 4.0 or d["k4"].circuit_depth == 5.0
    assert layers.count() == gates.count()


def test_graph(edges, spine):
    deg = graph.degrees(edges, spine)
    st = rows(graph.degree_stats(deg, spine), "file")
    assert (st["star"].graph_max_degree, st["star"].graph_median_degree, st["repeat"].graph_max_wdegree) == (4.0, 1.0, 3.0)
    cl = rows(graph.avg_clustering(edges, deg, spine), "file")
    assert (cl["k4"].graph_avg_clustering, cl["star"].graph_avg_clustering, cl["ccx"].graph_avg_clustering) == (1.0, 0.0, 1.0)
    labels = graph_search.component_labels(edges, spine)
    comp = rows(graph_search.components(labels, spine), "file")
    assert (comp["pairs"].graph_n_components, comp["ghz"].graph_n_components) == (4.0, 1.0)
    paths = rows(graph_search.path_metrics(edges, spine), "file")
    assert (paths["ghz"].graph_diameter, paths["star"].graph_diameter, paths["k4"].graph_avg_shortest_path) == (3.0, 2.0, 1.0)
    assert paths["ghz"].graph_avg_shortest_path == pytest.approx(10 / 6)
    core = graph_search.core_numbers(edges, spine)
    deg_core = rows(graph_search.degeneracy(core, spine), "file")
    width = rows(elimination.elimination_width(edges, spine), "file")
    assert (deg_core["k4"].graph_degeneracy, deg_core["star"].graph_degeneracy) == (3.0, 1.0)
    assert (width["k4"].graph_treewidth_min_degree, width["ghz"].graph_treewidth_min_fill, width["one"].graph_treewidth_min_fill) == (3.0, 1.0, 0.0)
    assert all(deg_core[f].graph_degeneracy <= width[f].graph_treewidth_min_degree for f in width)
    arb = rows(graph_search.arboricity_bound(edges, core, spine), "file")
    assert (arb["k4"].graph_arboricity, arb["ghz"].graph_arboricity) == (2.0, 1.0)
    flags = rows(graph.topology_flags(edges, deg, spine), "file")
    assert (flags["ghz"].is_nearest_neighbor, flags["star"].is_star_topology, flags["k4"].is_all_to_all, flags["one"].is_nearest_neighbor) == (1.0, 1.0, 1.0, 0.0)
    natural = graph.natural_order(edges)
    assert rows(graph.cutwidth(natural, spine, "natural"), "file")["k4"].graph_cutwidth_natural == 4.0
    assert rows(graph.recursive_bisection(natural, spine), "file")["ghz"].graph_recursive_bisection_max_cut == 1.0
    assert rows(graph.balanced_separator(natural, spine), "file")["k4"].graph_min_balanced_separator == 2.0
    assert rows(graph.cut_conductance(natural, spine), "file")["ghz"].graph_conductance_best_cut == pytest.approx(1 / 3)
    order = rows(elimination.min_degree_order(edges, spine).where("file = 'star'"), "node")
    assert [order[n].pos for n in range(5)] == [3, 0, 1, 2, 4]


def test_families(gates, edges, spine, texts):
    header = qasm.headers(texts)
    flags = graph.topology_flags(edges, graph.degrees(edges, spine), spine)
    traits = family.traits(gatemix.name_counts(gates), flags, family.long_range_only(gates, spine), header)
    got = {r.file: r.f for r in traits.select("file", family.classify_combined().alias("f")).collect()}
    assert got["ghz"] == "CutBell"  # 4 // 3 = 1, so a span of 1 is already long range, and that rule comes first
    assert got["ccx"] == "Grover_NoAncilla" and got["one"] == "Unknown" and got["two_regs"] == "Amplitude_Estimation"


def test_whole_frame(texts, spark):
    df = features_from_texts(texts.where("file IN ('ghz', 'k4', 'two_regs', 'empty')"))
    numeric = [c for c, t in df.dtypes if t == "double"]
    assert len(numeric) == 198 and df.count() == 4
    r = rows(df, "file")
    for f in r.values():
        assert f.edge_cutwidth_natural == f.graph_cutwidth_natural and f.entangling_cutwidth_natural == f.max_cut_pressure
    assert r["ghz"].circuit_depth == 4.0 and r["empty"].total_gates == 1.0 and r["empty"].predicted_family == "Unknown"


def test_no_pattern_runs_twice_on_a_statement(spark):
    texts = spark.createDataFrame([(1, "qreg a[2];\r\nqreg b[2];\r\tcx a[0] , b [1] ; \nrz(pi/2) b[0];\n\n"), (2, None)], "file long, text string")
    raw = qasm.gates_raw(qasm.statements(texts))
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("split(") == 2
    assert [(r.line_no, r.name, r.args, [tuple(o) for o in r.operands]) for r in raw.orderBy("line_no").collect()] == [
        (3, "cx", "", [("a", 0), ("b", 1)]), (4, "rz", "pi/2", [("b", 0)])]
    assert [(r.seq, r.qubits) for r in qasm.gates(texts).orderBy("seq").collect()] == [(3, [0, 3]), (4, [2])]
