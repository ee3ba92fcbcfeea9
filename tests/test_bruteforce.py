"""Random inputs against small plain-Python models."""

import math
import random

import numpy as np
import pytest

from gatelens.functions import quantiles
from gatelens.operators import cuts, depth, graph, graph_search, neighbours

NAMES = {"h": 1, "cx": 2, "ccx": 3}


def random_circuits(seed, n_files=6, n=7, size=60):
    rng, out = random.Random(seed), []
    for f in range(n_files):
        for s in range(size if f else 400):
            name = rng.choice(list(NAMES))
            out.append((f, s + 1, name, rng.sample(range(n), NAMES[name]), []))
    return out


def asap(circuit, n):
    free, layers = [0] * n, {}
    for _, s, _, qs, _ in circuit:
        start = max(free[q] for q in qs)
        layers[s] = start
        for q in qs:
            free[q] = start + 1
    return layers


@pytest.fixture(scope="module")
def data(spark):
    raw = random_circuits(7)
    gates = spark.createDataFrame(raw, "file long, seq long, name string, qubits array<int>, params array<double>")
    spine = spark.createDataFrame([(f, 7) for f in range(6)], "file long, n_qubits int")
    return raw, gates, spine


@pytest.mark.parametrize("block", [32_768, 50, 3])
def test_layers_do_not_depend_on_blocks(data, block):
    """Block size 3 makes 134 blocks of the first circuit, which takes two levels of the scan."""
    raw, gates, spine = data
    got = {(r.file, r.seq): r.layer for r in depth.asap_layers(gates, spine, dense=True, gate_block=block).collect()}
    want = {(f, s): v for f in range(6) for s, v in asap([g for g in raw if g[0] == f], 7).items()}
    assert got == want


def test_runs(data, monkeypatch):
    raw, gates, _ = data
    monkeypatch.setattr(cuts, "RUN_BLOCK", 8)
    got = {r.file: r for r in cuts.entangling_runs(gates, dense=True).collect()}
    for f in range(6):
        text = "".join("x" if g[2] != "h" else " " for g in raw if g[0] == f)
        lengths = [len(w) for w in text.split()]
        assert got[f].n_entangling_layers == len(lengths) and got[f].entangling_run_max == max(lengths)
        assert got[f].entangling_run_std == pytest.approx(float(np.std(lengths)))


def sparse_graphs(seed, n_files=8, n=70):
    rng, out = random.Random(seed), {}
    for f in range(n_files):
        out[f] = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(20 + 15 * f)}
    out[n_files] = {(i, i + 1) for i in range(n - 1)}
    return out


def test_searches(spark):
    n, graphs = 70, sparse_graphs(3)
    edges = spark.createDataFrame([(f, u, v, 1) for f, es in graphs.items() for u, v in es], "file int, u int, v int, weight long").cache()
    spine = spark.createDataFrame([(f, n) for f in graphs], "file int, n_qubits int").cache()
    labels = graph_search.component_labels(edges, spine)
    got_label = {(r.file, r.node): r.label for r in labels.collect()}
    got_core = {(r.file, r.node): r.core for r in graph_search.core_numbers(edges, spine).collect()}
    got_path = {r.file: r for r in graph_search.path_metrics(edges, spine).collect()}
    got_cl = {r.file: r.graph_avg_clustering for r in graph.avg_clustering(edges, graph.degrees(edges, spine), spine).collect()}
    for f, es in graphs.items():
        adj = {q: set() for q in range(n)}
        for u, v in es:
            adj[u].add(v)
            adj[v].add(u)
        dist = {}
        for s in range(n):
            seen, frontier, k = {s: 0}, [s], 0
            while frontier:
                k += 1
                frontier = [w for w in {w for q in frontier for w in adj[q]} if w not in seen]
                seen.update({w: k for w in frontier})
            dist[s] = seen
        assert all(got_label[f, q] == min(dist[q]) for q in range(n))
        comps = {}
        for q in range(n):
            comps.setdefault(min(dist[q]), []).append(q)
        big = max(comps.items(), key=lambda kv: (len(kv[1]), -kv[0]))[1]
        ds = [dist[a][b] for a in big for b in big if a != b]
        assert got_path[f].graph_avg_shortest_path == pytest.approx(sum(ds) / len(ds)) and got_path[f].graph_diameter == max(ds)
        left, core, k = {q: set(a) for q, a in adj.items()}, {}, 0
        while left:
            q = min(left, key=lambda x: len(left[x]))
            k = max(k, len(left[q]))
            core[q] = k
            for w in left.pop(q):
                left[w].discard(q)
        assert all(got_core[f, q] == core[q] for q in range(n))
        local = [sum(1 for a in adj[q] for b in adj[q] if a < b and b in adj[a]) * 2 / (len(adj[q]) * (len(adj[q]) - 1))
                 if len(adj[q]) > 1 else 0.0 for q in range(n)]
        assert got_cl[f] == pytest.approx(sum(local) / n)


def test_long_chain_next_to_small_circuits(spark):
    """A chain of 130 qubits next to many small circuits: the search takes one pass, whatever the chain's length."""
    chain = [("chain", i, i + 1, 1) for i in range(129)]
    small = [(f"s{k}", 0, 1, 1) for k in range(2000)]
    edges = spark.createDataFrame(chain + small, "file string, u int, v int, weight long").cache()
    spine = spark.createDataFrame([("chain", 130)] + [(f"s{k}", 2) for k in range(2000)], "file string, n_qubits int").cache()
    paths = {r.file: r for r in graph_search.path_metrics(edges, spine).collect()}
    assert paths["chain"].graph_diameter == 129 and paths["chain"].graph_avg_shortest_path == pytest.approx(131 / 3)
    assert len(paths) == 2001 and all(paths[f"s{k}"].graph_diameter == 1 for k in range(2000))
    assert graph_search.core_numbers(edges, spine).agg({"core": "max"}).first()[0] == 1


def test_quantiles_shuffle_no_raw_rows_by_key(spark):
    """Few groups reach the rows as a broadcast whose size was checked; many by salted keys."""
    from gatelens.functions import joins

    df = spark.range(5000).selectExpr("id % 7 as k", "double(id) as x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = quantiles.exact_quantiles(df, ["k"], ["x"], [0.5])
        plan = few._jdf.queryExecution().optimizedPlan().toString()
        assert "__salt" not in plan and "strategy=broadcast" in plan
        many = joins.join_small(df, df.select("k").distinct(), ["k"], bound=3)
        assert "hashpartitioning(k" in many._jdf.queryExecution().executedPlan().toString() and many.count() == 5000
        assert "__salt" in many._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_quantiles(spark, monkeypatch, accuracy):
    """A tiny sketch forces the bracketed path."""
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "MARGIN", 4.0 / accuracy)
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=3001), "b": rng.integers(0, 5, 500).astype(float), "c": np.array([4.0]), "d": np.array([1.0, 2.0]),
              "e": np.exp(rng.normal(scale=8, size=2000)), "f": np.zeros(300)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + [("a", float("nan")), ("a", None)], "k string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.prob): r.q for r in quantiles.exact_quantiles(df, ["k"], ["x"], probs).collect()}
    for k, xs in groups.items():
        for p in probs:
            assert got[k, p] == pytest.approx(float(np.quantile(xs, p)), rel=1e-12, abs=1e-300)


def knn(train, labels, query, k, skip=None):
    d = [(math.dist(query, x), i) for i, x in enumerate(train) if i != skip]
    near = sorted(d)[:k]
    votes = {}
    hit = near[0][0] == 0
    for dist, i in near:
        w = float(dist == 0) if hit else 1 / dist
        votes[labels[i]] = votes.get(labels[i], 0.0) + w
    return min(votes, key=lambda c: (-votes[c], c)), max(votes.values()) / sum(votes.values())


@pytest.mark.parametrize("block", [8192, 16])
def test_neighbours(spark, monkeypatch, block):
    """Clustered points, a third of them in one spot; small blocks cut the crowded cell into pieces."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "PIVOTS", 8)
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(size=(40, 3)) * 0.01 + 5, rng.normal(size=(80, 3)), np.ones((3, 3))])
    labels = [int(x) for x in rng.integers(0, 4, len(pts))]
    df = spark.createDataFrame([(i, labels[i], [float(v) for v in p]) for i, p in enumerate(pts)], "vec_id long, label int, x array<double>")
    train, test = df.where("vec_id % 3 <> 0"), df.where("vec_id % 3 = 0").drop("label")
    ids = [i for i in range(len(pts)) if i % 3]
    base = pts[ids]
    scaled = (pts - base.mean(0)) / base.std(0)
    got = {r.vec_id: (r.label, r.probability) for r in neighbours.knn_classify(train, test, 3).collect()}
    for i in range(0, len(pts), 3):
        label, p = knn(scaled[ids], [labels[j] for j in ids], scaled[i], 3)
        assert got[i][0] == label and got[i][1] == pytest.approx(p, rel=1e-6)
    loo = {r.vec_id: r.predicted for r in neighbours.knn_leave_one_out(df, 3).collect()}
    for i in range(len(pts)):
        rest = np.delete(pts, i, axis=0)
        z = (pts - rest.mean(0)) / rest.std(0)
        assert loo[i] == knn(z, labels, z[i], 3, skip=i)[0]


def test_cut_pressure(data):
    raw, gates, spine = data
    got = {r.file: r for r in cuts.cut_pressure(cuts.interaction_graph(cuts.interactions(gates)), spine).collect()}
    for f in range(6):
        p = np.zeros(7)
        for g in raw:
            qs = g[3]
            pairs = [(a, b) for i, a in enumerate(qs) for b in qs[i + 1:]] if g[0] == f else []
            for a, b in pairs:
                p[min(a, b) + 1:max(a, b) + 1] += 1
        p = p[1:]
        share = p[p > 0] / p.sum()
        assert got[f].max_cut_pressure == p.max() and got[f].std_cut_pressure == pytest.approx(p.std())
        assert got[f].cut_pressure_entropy == pytest.approx(-(share * np.log2(share)).sum())


def test_neighbours_travel_once_per_block(spark, monkeypatch):
    """Cells smaller than a block share one: no test row is copied to each of the cells that it must see."""
    routed = []
    monkeypatch.setattr(neighbours, "cut", lambda df: routed.append(df.count()) or df)
    monkeypatch.setattr(neighbours, "COPIES", 7)
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.gauss(0, 1) for _ in range(12)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, label int, x array<double>")
    assert neighbours.knn_leave_one_out(df, 3).count() == 120 and routed == [120]
