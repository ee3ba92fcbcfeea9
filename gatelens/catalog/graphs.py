"""Layers, interaction-graph metrics, orders, families by rule and by neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelens import fixtures as fx
from gatelens.catalog import query
from gatelens.catalog import sqlviews as v
from gatelens.catalog.common import rounded
from gatelens.constants import FAMILY_RULES
from gatelens.functions.lineage import cut
from gatelens.operators import cuts, depth, elimination, family, gatemix, graph, graph_search, neighbours, splits

# ------------------------------------------------------------------ layers

LAYERS = """
walk AS (
  SELECT file, 0::BIGINT AS seq, [0,0,0,0,0,0,0,0]::BIGINT[] AS t, NULL::VARCHAR AS name, NULL::INTEGER[] AS qs, NULL::BIGINT AS layer FROM spine
  UNION ALL
  SELECT w.file, g.seq,
         list_transform(range(0, 8), lambda i: CASE WHEN list_contains(g.qs, i::INTEGER) THEN list_max(list_transform(g.qs, lambda q: w.t[q + 1])) + 1 ELSE w.t[i + 1] END),
         g.name, g.qs, list_max(list_transform(g.qs, lambda q: w.t[q + 1]))
  FROM walk w JOIN (SELECT *, CASE WHEN name = 'ccx' THEN [a, b, c] WHEN name IN ('cx','cz','cp') THEN [a, b] ELSE [a] END AS qs FROM v_gates) g
    ON g.file = w.file AND g.seq = w.seq + 1),
layers AS (SELECT * FROM walk WHERE layer IS NOT NULL)"""


def _layers(spark, sf):
    return depth.asap_layers(fx.v_gates_small(spark, sf), fx.v_circuits_small(spark, sf), dense=True)


@query("d6_asap_layers", "WITH RECURSIVE " + v.V_GATES_SMALL + "," + v.SPINE + "," + LAYERS + " SELECT file, seq, layer FROM layers")
def d6(spark, sf):
    return _layers(spark, sf).select("file", "seq", "layer")


@query("d7_layer_stats", "WITH RECURSIVE " + v.V_GATES_SMALL + "," + v.SPINE + "," + LAYERS + """,
per AS (SELECT file, layer, count(*) AS g, sum(len(qs)) AS act, count(*) FILTER (WHERE name IN ('cx','cz','cp')) AS n2,
        count(*) FILTER (WHERE name = 'ccx') AS n3 FROM layers GROUP BY 1, 2)
SELECT file, max(layer) + 1.0::DOUBLE AS circuit_depth, round((max(layer) + 1) / 8.0::DOUBLE, 6) AS depth_per_qubit,
  round(sum(g) / (8.0::DOUBLE * (max(layer) + 1)), 6) AS gate_density, round(sum(g) / (max(layer) + 1.0::DOUBLE), 6) AS avg_parallel_gates,
  max(g)::DOUBLE AS max_parallel_gates, round(stddev_pop(g), 6) AS std_parallel_gates,
  round(sum(g) / (max(layer) + 1.0::DOUBLE) / 8, 6) AS parallel_gates_per_qubit, round(max(g) / 8.0::DOUBLE, 6) AS max_parallel_gates_per_qubit,
  round(avg(act), 6) AS avg_active_qubits, max(act)::DOUBLE AS max_active_qubits, round(stddev_pop(act), 6) AS std_active_qubits,
  round(avg(act) / 8, 6) AS active_qubit_ratio, round(avg(n2), 6) AS avg_2q_gates_per_layer, round(avg(n3), 6) AS avg_3q_gates_per_layer,
  max(n2)::DOUBLE AS max_2q_gates_per_layer, max(n3)::DOUBLE AS max_3q_gates_per_layer
FROM per GROUP BY file""")
def d7(spark, sf):
    return rounded(depth.layer_stats(_layers(spark, sf), fx.v_circuits_small(spark, sf)))


# ------------------------------------------------------------------ graph metrics

def _graph(spark, sf):
    edges = cuts.interaction_graph(cuts.interactions(fx.v_gates(spark, sf, with_seq=False)))
    return edges, fx.v_circuits(spark, sf)


def _small_graph(spark, sf):
    edges = cuts.interaction_graph(cuts.interactions(fx.v_gates_small(spark, sf, with_seq=False)))
    return edges, fx.v_circuits_small(spark, sf)


def _dist(c, s):
    return f"""max({c})::DOUBLE AS graph_max_{s}, round(avg({c}), 6) AS graph_mean_{s}, round(stddev_pop({c}), 6) AS graph_std_{s},
  min({c})::DOUBLE AS graph_min_{s}, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS graph_median_{s},
  round(quantile_cont({c}::DOUBLE, 0.25), 6) AS graph_p25_{s}, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS graph_p75_{s}"""


BASE = (v.V_GATES, v.INTER, v.EDGES, v.SPINE)
SMALL = (v.V_GATES_SMALL, v.INTER, v.EDGES, v.SPINE)


@query("e1_degree_stats", v.with_views(*BASE, v.NODES, body=f"SELECT file, {_dist('deg', 'degree')}, {_dist('wdeg', 'wdegree')} FROM deg GROUP BY file"))
def e1(spark, sf):
    edges, spine = _graph(spark, sf)
    return rounded(graph.degree_stats(graph.degrees(edges, spine), spine))


@query("e2_degree_entropy", v.with_views(*BASE, v.NODES, """
p AS (SELECT file, deg / nullif(sum(deg) OVER (PARTITION BY file), 0) AS p FROM deg)""", body="""
SELECT file, round(coalesce(-sum(CASE WHEN p > 0 THEN p * log2(p) END), 0), 6) AS graph_degree_entropy FROM p GROUP BY file"""))
def e2(spark, sf):
    edges, spine = _graph(spark, sf)
    return rounded(graph.degree_entropy(graph.degrees(edges, spine), spine))


@query("e3_density", v.with_views(*BASE, body="""
SELECT file, count(u)::DOUBLE AS graph_n_edges, round(count(u) / 2016.0::DOUBLE, 6) AS graph_density, round(1 - count(u) / 2016.0::DOUBLE, 6) AS graph_sparsity
FROM spine LEFT JOIN edges USING (file) GROUP BY file"""))
def e3(spark, sf):
    edges, spine = _graph(spark, sf)
    return rounded(graph.edge_totals(edges, spine).select("file", "graph_n_edges", "graph_density", "graph_sparsity"))


REACH = """
ends AS (SELECT file, u AS node, v AS other FROM edges UNION ALL SELECT file, v, u FROM edges),
nodes AS (SELECT file, unnest(range(0, n_qubits)) AS node FROM spine),
walk AS (SELECT file, node AS src, node AS dst, 0 AS dist FROM nodes
  UNION SELECT w.file, w.src, e.other, w.dist + 1 FROM walk w JOIN ends e ON e.file = w.file AND e.node = w.dst WHERE w.dist < 7),
dists AS (SELECT file, src, dst, min(dist) AS dist FROM walk GROUP BY 1, 2, 3),
comp AS (SELECT file, src AS node, min(dst) AS label FROM dists GROUP BY 1, 2),
sizes AS (SELECT file, label, count(*) AS size FROM comp GROUP BY 1, 2)"""
SMALL_RECURSIVE = "WITH RECURSIVE " + ",".join(SMALL) + "," + REACH


@query("e4_components", SMALL_RECURSIVE + """
SELECT file, count(*)::DOUBLE AS graph_n_components, round(max(size) / 8.0::DOUBLE, 6) AS graph_largest_component_frac FROM sizes GROUP BY file""")
def e4(spark, sf):
    edges, spine = _small_graph(spark, sf)
    return rounded(graph_search.components(graph_search.component_labels(edges, spine), spine))


@query("e5_avg_clustering", v.with_views(*BASE, v.NODES, """
tri AS (SELECT x.file, x.node, count(*) AS t2 FROM ends x JOIN ends y ON y.file = x.file AND y.node = x.node
  JOIN edges e ON e.file = x.file AND e.u = x.other AND e.v = y.other GROUP BY 1, 2)""", body="""
SELECT file, round(sum(CASE WHEN deg >= 2 THEN 2.0::DOUBLE * coalesce(t2, 0) / (deg * (deg - 1)) ELSE 0 END) / 64, 6) AS graph_avg_clustering
FROM deg LEFT JOIN tri USING (file, node) GROUP BY file"""))
def e5(spark, sf):
    edges, spine = _graph(spark, sf)
    return rounded(graph.avg_clustering(edges, graph.degrees(edges, spine), spine))


def _peel(rounds: int) -> str:
    """Unrolled k-core check: a node is in the k-core if it survives ``rounds`` removals, k = 1..3, on 8 qubits."""
    parts = []
    for k in (1, 2, 3, 4, 5, 6, 7):
        prev = "ends"
        for i in range(rounds):
            parts.append(f"k{k}_{i} AS (SELECT e.* FROM {prev} e JOIN (SELECT file, node FROM {prev} GROUP BY 1, 2 HAVING count(*) >= {k}) a "
                         f"ON a.file = e.file AND a.node = e.node JOIN (SELECT file, node FROM {prev} GROUP BY 1, 2 HAVING count(*) >= {k}) b "
                         f"ON b.file = e.file AND b.node = e.other)")
            prev = f"k{k}_{i}"
        parts.append(f"c{k} AS (SELECT DISTINCT file, node, {k} AS k FROM {prev})")
    return ",".join(parts)


E6_SQL = v.with_views(*SMALL, """
ends AS (SELECT file, u AS node, v AS other FROM edges UNION ALL SELECT file, v, u FROM edges),
nodes AS (SELECT file, unnest(range(0, 8)) AS node FROM spine)""", _peel(8), body="""
SELECT n.file, CAST(n.node AS INTEGER) AS node, CAST(coalesce(max(k), 0) AS INTEGER) AS core FROM nodes n LEFT JOIN (""" + " UNION ALL ".join(
    f"SELECT * FROM c{k}" for k in range(1, 8)) + """) c ON c.file = n.file AND c.node = n.node GROUP BY 1, 2""")


@query("e6_core_numbers", E6_SQL)
def e6(spark, sf):
    return graph_search.core_numbers(*_small_graph(spark, sf))


# Neighbours of each of the eight qubits as bits; recursive queries take one qubit out of every circuit per step.
MASKS = """
bits AS (SELECT file, u AS node, sum(DISTINCT 1 << v) AS m FROM (SELECT file, u, v FROM edges WHERE u <> v UNION ALL SELECT file, v, u FROM edges WHERE u <> v) GROUP BY 1, 2),
masks AS (SELECT s.file, list(coalesce(m, 0)::BIGINT ORDER BY r.i) AS masks FROM spine s CROSS JOIN range(8) r(i) LEFT JOIN bits b ON b.file = s.file AND b.node = r.i GROUP BY 1)"""
DEGREE_PICK = "list_min(list_transform(list_filter(range(8), lambda i: (rest >> i) & 1 = 1), lambda i: bit_count(masks[i + 1] & rest) * 8 + i)) % 8"
FILL_PICK = """list_min(list_transform(list_filter(range(8), lambda i: (rest >> i) & 1 = 1), lambda i: bit_count(masks[i + 1] & rest) * 10 + i + 1000 *
  coalesce(list_sum(list_transform(list_filter(range(8), lambda o: ((masks[i + 1] & rest) >> o) & 1 = 1),
    lambda o: bit_count(masks[i + 1] & rest) - 1 - bit_count(masks[i + 1] & masks[o + 1] & rest))), 0)::BIGINT)) % 10"""


def _eliminate(name, pick):
    """Rows (file, width) of eliminating with fill-in."""
    return f"""
{name}_steps AS (SELECT file, masks, 255::BIGINT AS rest, 0::BIGINT AS width FROM masks UNION ALL
  SELECT file, list_transform(range(8), lambda i: CASE WHEN (around >> i) & 1 = 1 THEN (masks[i + 1] | around) - (1 << i) ELSE masks[i + 1] END),
    rest - (1 << q), greatest(width, bit_count(around))::BIGINT
  FROM (SELECT *, masks[q + 1] & rest AS around FROM (SELECT *, ({pick})::INTEGER AS q FROM {name}_steps WHERE rest > 0))),
{name} AS (SELECT file, width FROM {name}_steps WHERE rest = 0)"""


@query("e7_elimination_width", "WITH RECURSIVE " + ",".join([*SMALL, MASKS, _eliminate("by_degree", DEGREE_PICK), _eliminate("by_fill", FILL_PICK)]) + """
SELECT file, a.width::DOUBLE AS graph_treewidth_min_degree, b.width::DOUBLE AS graph_treewidth_min_fill FROM by_degree a JOIN by_fill b USING (file)""")
def e7(spark, sf):
    return elimination.elimination_width(*_small_graph(spark, sf))


ORDERED = "WITH RECURSIVE " + ",".join([*SMALL, MASKS]) + f""",
taken AS (SELECT file, masks, 255::BIGINT AS rest, -1 AS node, -1 AS pos FROM masks UNION ALL
  SELECT file, masks, rest - (1 << q), q, pos + 1 FROM (SELECT *, ({DEGREE_PICK})::INTEGER AS q FROM taken WHERE rest > 0)),
placed AS (SELECT e.file, least(a.pos, b.pos) AS lo, greatest(a.pos, b.pos) AS hi FROM edges e
  JOIN taken a ON a.file = e.file AND a.node = e.u JOIN taken b ON b.file = e.file AND b.node = e.v WHERE e.u <> e.v)"""


@query("e8_min_degree_order", ORDERED + " SELECT file, node, pos FROM taken WHERE pos >= 0")
def e8(spark, sf):
    return elimination.min_degree_order(*_small_graph(spark, sf))


def _heuristic(spark, sf):
    edges, spine = _small_graph(spark, sf)
    return graph.ordered_edges(edges, elimination.min_degree_order(edges, spine)), spine


@query("e9_bandwidth", v.with_views(*BASE, body="""
SELECT file, coalesce(max(v - u), 0)::DOUBLE AS graph_bandwidth_natural FROM spine LEFT JOIN edges USING (file) GROUP BY file"""))
def e9(spark, sf):
    edges, spine = _graph(spark, sf)
    return graph.bandwidth(graph.natural_order(edges), spine, "natural").select("file", "graph_bandwidth_natural")


@query("e9_bandwidth_heuristic", ORDERED + """
SELECT file, coalesce(max(hi - lo), 0)::DOUBLE AS graph_bandwidth_heuristic, coalesce(sum(hi - lo), 0)::DOUBLE AS graph_linear_arrangement_heuristic
FROM spine LEFT JOIN placed USING (file) GROUP BY file""")
def e9h(spark, sf):
    placed, spine = _heuristic(spark, sf)
    return graph.bandwidth(placed, spine, "heuristic")


@query("e10_cutwidth_heuristic", ORDERED + """,
x AS (SELECT file, unnest(range(lo + 1, hi + 1)) AS cut FROM placed), c AS (SELECT file, cut, count(*) AS n FROM x GROUP BY 1, 2)
SELECT file, coalesce(max(n), 0)::DOUBLE AS graph_cutwidth_heuristic FROM spine LEFT JOIN c USING (file) GROUP BY file""")
def e10h(spark, sf):
    placed, spine = _heuristic(spark, sf)
    return graph.cutwidth(placed, spine, "heuristic")


@query("e10_cutwidth", v.with_views(*BASE, """
x AS (SELECT file, unnest(range(u + 1, v + 1)) AS cut FROM edges), c AS (SELECT file, cut, count(*) AS n FROM x GROUP BY 1, 2)""", body="""
SELECT file, coalesce(max(n), 0)::DOUBLE AS graph_cutwidth_natural FROM spine LEFT JOIN c USING (file) GROUP BY file"""))
def e10(spark, sf):
    edges, spine = _graph(spark, sf)
    return graph.cutwidth(graph.natural_order(edges), spine, "natural")


@query("e11_linear_arrangement", v.with_views(*BASE, body="""
SELECT file, coalesce(sum(v - u), 0)::DOUBLE AS graph_linear_arrangement_natural FROM spine LEFT JOIN edges USING (file) GROUP BY file"""))
def e11(spark, sf):
    edges, spine = _graph(spark, sf)
    return graph.bandwidth(graph.natural_order(edges), spine, "natural").select("file", "graph_linear_arrangement_natural")


@query("e12_balanced_separator", v.with_views(*BASE, """
x AS (SELECT * FROM edges WHERE u < 32 AND v >= 32)""", body="""
SELECT file, least(count(DISTINCT u), count(DISTINCT v))::DOUBLE AS graph_min_balanced_separator FROM spine LEFT JOIN x USING (file) GROUP BY file"""))
def e12(spark, sf):
    edges, spine = _graph(spark, sf)
    return graph.balanced_separator(graph.natural_order(edges), spine)


@query("e13_recursive_bisection", v.with_views(*BASE, """
lv AS (SELECT file, k, u // (64 // 2 ** k)::INTEGER AS part, (u // (32 // 2 ** k)::INTEGER) <> (v // (32 // 2 ** k)::INTEGER) AS split
  FROM edges, range(0, 6) AS r(k) WHERE u // (64 // 2 ** k)::INTEGER = v // (64 // 2 ** k)::INTEGER),
parts AS (SELECT file, k, part, count(*) FILTER (WHERE split) AS cut FROM lv GROUP BY 1, 2, 3)""", body="""
SELECT file, coalesce(max(cut), 0)::DOUBLE AS graph_recursive_bisection_max_cut, round(coalesce(avg(cut), 0), 6) AS graph_recursive_bisection_avg_cut
FROM spine LEFT JOIN parts USING (file) GROUP BY file"""))
def e13(spark, sf):
    edges, spine = _graph(spark, sf)
    return rounded(graph.recursive_bisection(graph.natural_order(edges), spine))


@query("e14_cut_conductance", v.with_views(*BASE, """
x AS (SELECT file, (u < 32)::INTEGER + (v < 32)::INTEGER AS near FROM edges)""", body="""
SELECT file, round(coalesce(count(*) FILTER (WHERE near = 1) / nullif(least(sum(near), sum(2 - near)), 0)::DOUBLE, 0), 6) AS graph_conductance_best_cut
FROM spine LEFT JOIN x USING (file) GROUP BY file"""))
def e14(spark, sf):
    edges, spine = _graph(spark, sf)
    return rounded(graph.cut_conductance(graph.natural_order(edges), spine))


@query("e15_path_metrics", SMALL_RECURSIVE + """,
big AS (SELECT file, arg_max(label, size * 100 - label) AS label FROM sizes WHERE size > 1 GROUP BY file),
pairs AS (SELECT d.file, d.dist FROM dists d JOIN comp c ON c.file = d.file AND c.node = d.src JOIN big b ON b.file = c.file AND b.label = c.label WHERE d.src <> d.dst)
SELECT file, round(coalesce(avg(dist), 0), 6) AS graph_avg_shortest_path, coalesce(max(dist), 0)::DOUBLE AS graph_diameter
FROM spine LEFT JOIN pairs USING (file) GROUP BY file""")
def e15(spark, sf):
    edges, spine = _small_graph(spark, sf)
    return rounded(graph_search.path_metrics(edges, spine))


@query("e16_edge_weight_stats", v.with_views(*BASE, body="""
SELECT file, coalesce(max(weight), 0)::DOUBLE AS graph_max_edge_weight, round(coalesce(avg(weight), 0), 6) AS graph_mean_edge_weight
FROM spine LEFT JOIN edges USING (file) GROUP BY file"""))
def e16(spark, sf):
    edges, spine = _graph(spark, sf)
    return rounded(graph.edge_totals(edges, spine).select("file", "graph_max_edge_weight", "graph_mean_edge_weight"))


FLAGS = """
tops AS (SELECT file, max(deg) AS top FROM deg GROUP BY file),
flags AS (SELECT file, coalesce(bool_and(v - u = 1), false) AS nn, (count(u) > 0 AND max(top) >= 0.8 * ({n} - 1)) AS star,
  (count(u) >= 0.8 * {n} * ({n} - 1) / 2) AS dense FROM spine LEFT JOIN edges USING (file) LEFT JOIN tops USING (file) GROUP BY file)"""


@query("e17_topology_flags", v.with_views(*SMALL, v.NODES, FLAGS.format(n=8), body="""
SELECT file, nn::INTEGER::DOUBLE AS is_nearest_neighbor, star::INTEGER::DOUBLE AS is_star_topology, dense::INTEGER::DOUBLE AS is_all_to_all FROM flags"""))
def e17(spark, sf):
    edges, spine = _small_graph(spark, sf)
    return graph.topology_flags(edges, graph.edge_degrees(edges), spine)


@query("e18_arboricity_bound", E6_SQL.replace("SELECT n.file, CAST(n.node AS INTEGER) AS node", ", core AS (SELECT n.file, CAST(n.node AS INTEGER) AS node", 1) + """),
ce AS (SELECT e.file, least(a.core, b.core) AS k FROM edges e JOIN core a ON a.file = e.file AND a.node = e.u JOIN core b ON b.file = e.file AND b.node = e.v WHERE e.u <> e.v),
pk AS (SELECT file, r.k, (SELECT count(*) FROM ce WHERE ce.file = s.file AND ce.k >= r.k) AS e, (SELECT count(*) FROM core c WHERE c.file = s.file AND c.core >= r.k) AS n
  FROM spine s, range(8) r(k))
SELECT file, max(CASE WHEN n > 1 THEN ceil(e / (n - 1)) ELSE 0 END)::DOUBLE AS graph_arboricity FROM pk GROUP BY file""")
def e18(spark, sf):
    edges, spine = _small_graph(spark, sf)
    return graph_search.arboricity_bound(edges, graph_search.core_numbers(edges, spine), spine)


# The same searches over the 64-qubit circuits, in blocks so small that every circuit goes through the rounds of joins.
WIDE = "WITH RECURSIVE " + ",".join(BASE) + "," + REACH.replace("w.dist < 7", "w.dist < 9")


@query("e4_components_wide", WIDE + """
SELECT file, node::INTEGER AS node, label::INTEGER AS label FROM comp""")
def e4_wide(spark, sf):
    edges, spine = _graph(spark, sf)
    return graph_search.component_labels(cut(edges), spine, 16)


PEEL = """
bits AS (SELECT file, u AS node, sum(DISTINCT 1::HUGEINT << v) AS m FROM (SELECT file, u, v FROM edges WHERE u <> v UNION ALL SELECT file, v, u FROM edges WHERE u <> v) GROUP BY 1, 2),
masks AS (SELECT s.file, list(coalesce(m, 0)::HUGEINT ORDER BY r.i) AS masks FROM spine s CROSS JOIN range(64) r(i) LEFT JOIN bits b ON b.file = s.file AND b.node = r.i GROUP BY 1),
peeled AS (SELECT file, masks, (1::HUGEINT << 64) - 1 AS rest, -1 AS node, 0::BIGINT AS core FROM masks UNION ALL
  SELECT file, masks, rest - (1::HUGEINT << q), q, greatest(core, bit_count(masks[q + 1] & rest))::BIGINT FROM (SELECT *,
    (list_min(list_transform(list_filter(range(64), lambda i: (rest >> i) & 1 = 1), lambda i: bit_count(masks[i + 1] & rest)::INTEGER * 64 + i)) % 64)::INTEGER AS q FROM peeled WHERE rest > 0))"""


@query("e6_core_numbers_wide", "WITH RECURSIVE " + ",".join([*BASE, PEEL]) + " SELECT file, node, core::INTEGER AS core FROM peeled WHERE node >= 0")
def e6_wide(spark, sf):
    edges, spine = _graph(spark, sf)
    return graph_search.core_numbers(cut(edges), spine, 16, 300)


@query("e15_path_metrics_wide", WIDE + """,
big AS (SELECT file, arg_max(label, size * 100 - label) AS label FROM sizes WHERE size > 1 GROUP BY file),
pairs AS (SELECT d.file, d.dist FROM dists d JOIN comp c ON c.file = d.file AND c.node = d.src JOIN big b ON b.file = c.file AND b.label = c.label WHERE d.src <> d.dst)
SELECT file, round(coalesce(avg(dist), 0), 6) AS graph_avg_shortest_path, coalesce(max(dist), 0)::DOUBLE AS graph_diameter
FROM spine LEFT JOIN pairs USING (file) GROUP BY file""")
def e15_wide(spark, sf):
    edges, spine = _graph(spark, sf)
    return rounded(graph_search.path_metrics(cut(edges), spine, 16, 24))


# ------------------------------------------------------------------ families

def _check_sql(check):
    return {None: "true", "qregs>=2": "2 >= 2", "qregs>=3": "2 >= 3", "all_to_all": "dense", "nearest_neighbor": "nn",
            "star": "star", "long_range_only": "far"}[check]


def _rule_sql(rule):
    fam, req, any_of, forb, types, check = rule
    conds = [f"list_has_all(names, {list(req)})"]
    if any_of:
        conds.append(f"list_has_any(names, {list(any_of)})")
    if forb:
        conds.append(f"NOT list_has_any(names, {list(forb)})")
    if types:
        conds.append(f"len(names) <= {types}")
    conds.append(_check_sql(check))
    return f"WHEN {' AND '.join(conds)} THEN '{fam}'"


# rules need richer gate names than the seven of v_gates, so each circuit's names are spread over the rule alphabet
RENAMED = ["cx", "cp", "h", "ry", "cz", "swap", "ccx", "u2", "rzz", "rx", "x", "p", "cu"]
V_NAMED = f"""
v_gates AS (
  SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq,
         {RENAMED}[(l_orderkey % 5 + l_partkey % 2 + (l_linenumber % 3) * (1 + l_orderkey % 4)) % 13 + 1] AS name,
         CAST(l_partkey % 8 AS INTEGER) AS a, CAST((l_partkey + 1 + l_suppkey % 7) % 8 AS INTEGER) AS b,
         CAST((l_partkey + 1 + (l_suppkey + 1) % 7) % 8 AS INTEGER) AS c, 8 AS n_qubits
  FROM lineitem),
inter AS (
  SELECT file, seq, a, b FROM v_gates WHERE name IN ('cx','cp','cz','swap','rzz','cu','ccx')
  UNION ALL SELECT file, seq, a, c FROM v_gates WHERE name = 'ccx'
  UNION ALL SELECT file, seq, b, c FROM v_gates WHERE name = 'ccx'),
sets AS (SELECT file, list(DISTINCT name) AS names, coalesce(min(CASE WHEN name IN ('cx','cp','cz','swap','rzz','cu') THEN abs(a - b) END) >= 2, true) AS far FROM v_gates GROUP BY file)"""


def v_named(spark, sf):
    o, p, line, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
    name = F.element_at(F.array(*[F.lit(g) for g in RENAMED]),
                        ((o % 5 + p % 2 + (line % 3) * (1 + o % 4)) % 13 + 1).cast("int"))
    abc = F.array((p % 8).cast("int"), ((p + 1 + s % 7) % 8).cast("int"), ((p + 1 + (s + 1) % 7) % 8).cast("int"))
    li = fx.table(spark, sf, "lineitem").select(o.alias("file"), name.alias("name"), abc.alias("abc"))
    arity = F.when(F.col("name") == "ccx", 3).when(F.col("name").isin("cx", "cp", "cz", "swap", "rzz", "cu"), 2).otherwise(1)
    return li.select("file", "name", F.slice("abc", 1, arity).alias("qubits"))


CLASSIFIED = V_NAMED + "," + v.EDGES + "," + v.SPINE + "," + v.NODES + "," + FLAGS.format(n=8) + """,
ruled AS (SELECT s.file, names, CASE """ + "\n".join(_rule_sql(r) for r in FAMILY_RULES) + """ END AS rule_family FROM sets s JOIN flags USING (file))"""


def _traits(spark, sf):
    g = v_named(spark, sf)
    spine = fx.v_circuits_small(spark, sf)
    edges = cuts.interaction_graph(cuts.interactions(g))
    flags = graph.topology_flags(edges, graph.edge_degrees(edges), spine)
    return family.traits(gatemix.name_counts(g), flags, family.long_range_only(g, spine), spine)


@query("f1_classify_rules", "WITH " + CLASSIFIED + " SELECT file, rule_family FROM ruled")
def f1(spark, sf):
    return _traits(spark, sf).select("file", family.classify_rules().alias("rule_family"))


@query("f2_long_range_only", "WITH " + V_NAMED + " SELECT file, far AS long_range_only FROM sets")
def f2(spark, sf):
    return family.long_range_only(v_named(spark, sf), fx.v_circuits_small(spark, sf))


COMBINED = """
combined AS (SELECT file, coalesce(rule_family, CASE WHEN list_contains(names, 'rzz') THEN 'QAOA' WHEN list_contains(names, 'cswap') THEN 'Shor'
  WHEN list_has_any(names, ['rccx', 'ccx']) THEN 'Grover_V_Chain' WHEN list_contains(names, 'cry') THEN 'Pricing_Call'
  WHEN list_contains(names, 'cp') THEN 'Amplitude_Estimation' ELSE 'Unknown' END) AS predicted_family FROM ruled)"""


@query("f3_classify_combined", "WITH " + CLASSIFIED + "," + COMBINED + " SELECT file, predicted_family FROM combined")
def f3(spark, sf):
    return _traits(spark, sf).select("file", family.classify_combined().alias("predicted_family"))


KNN = """
d AS (SELECT {test} AS vec_id, t.vec_id AS other, t.label, {dist} AS d FROM {frm}),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS rk FROM d QUALIFY rk <= 3),
votes AS (SELECT vec_id, label, sum(CASE WHEN z THEN CASE WHEN d = 0 THEN 1.0::DOUBLE ELSE 0 END ELSE 1 / d END) AS w
  FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) = 0 AS z FROM near) GROUP BY 1, 2)"""

SCALED = """
held AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR || '#42'), vec_id) <= ceil((SELECT count(*) FROM embeddings) * 0.25::DOUBLE) AS is_val FROM embeddings),
dims AS (SELECT vec_id, is_val, label, i, embedding[i]::DOUBLE AS x FROM embeddings JOIN held USING (vec_id), range(1, 65) AS r(i)),
stats AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM dims WHERE NOT is_val GROUP BY i),
scaled AS (SELECT vec_id, is_val, label, list((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END ORDER BY i) AS x FROM dims JOIN stats USING (i) GROUP BY 1, 2, 3)"""


@query("f4_knn_classify", "WITH " + SCALED + "," + KNN.format(
    test="q.vec_id", dist="list_distance(q.x, t.x)", frm="scaled q, scaled t WHERE q.is_val AND NOT t.is_val") + """
SELECT vec_id, arg_max(label, w) AS label, round(max(w) / sum(w), 6) AS probability FROM (SELECT * FROM votes ORDER BY w, label DESC) GROUP BY vec_id""")
def f4(spark, sf):
    points = fx.v_points(spark, sf)
    held = cut(points.join(splits.group_holdout(points, "vec_id", 0.25, 42), "vec_id"))
    train, test = held.where("NOT is_val").drop("is_val"), held.where("is_val").drop("is_val", "label")
    return rounded(neighbours.knn_classify(train, test, 3))


LOO = """
dims AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) AS r(i)),
sums AS (SELECT i, count(*)::DOUBLE AS n, avg(x) AS c FROM dims GROUP BY i),
mom AS (SELECT i, n, c, sum(x - c) AS s1, sum((x - c) * (x - c)) AS s2 FROM dims JOIN sums USING (i) GROUP BY ALL),
loo AS (SELECT vec_id, i, x, (s2 - (x - c) * (x - c)) / (n - 1) - ((s1 - (x - c)) / (n - 1)) ** 2 AS var FROM dims JOIN mom USING (i)),
pt AS (SELECT vec_id, list(x ORDER BY i) AS x, list(1 / sqrt(CASE WHEN var > 1e-18 THEN var ELSE 1 END) ORDER BY i) AS w FROM loo GROUP BY 1),
raw AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)"""


@query("f5_knn_leave_one_out", "WITH " + LOO + "," + KNN.format(
    test="q.vec_id", frm="pt q, raw t WHERE q.vec_id <> t.vec_id",
    dist="sqrt(list_sum(list_transform(range(1, 65), lambda i: ((q.x[i] - t.x[i]) * q.w[i]) ** 2)))") + """
SELECT vec_id, arg_max(label, w) AS predicted FROM (SELECT * FROM votes ORDER BY w, label DESC) GROUP BY vec_id""")
def f5(spark, sf):
    return neighbours.knn_leave_one_out(fx.v_points(spark, sf), 3).select("vec_id", "predicted")


@query("f6_family_accuracy", "WITH " + CLASSIFIED + "," + COMBINED + """,
t AS (SELECT c.file, predicted_family, CASE WHEN o_orderstatus = 'F' THEN predicted_family WHEN o_orderstatus = 'O' THEN 'GHZ' ELSE 'QFT' END AS true_family
  FROM combined c JOIN orders ON o_orderkey = c.file)
SELECT count(*) FILTER (WHERE true_family = predicted_family) AS n_correct, count(*) AS n_total,
  round(count(*) FILTER (WHERE true_family = predicted_family) / count(*), 6) AS accuracy FROM t""")
def f6(spark, sf):
    status = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), "o_orderstatus")
    named = _traits(spark, sf).select("file", family.classify_combined().alias("predicted_family")).join(status, "file")
    truth = F.when(F.col("o_orderstatus") == "F", F.col("predicted_family")).when(F.col("o_orderstatus") == "O", "GHZ").otherwise("QFT")
    return rounded(family.family_accuracy(named.withColumn("true_family", truth)))
