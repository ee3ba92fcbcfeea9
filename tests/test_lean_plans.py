"""Rows that a metric does not need are not made."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gatelens import fixtures as fx
from gatelens.functions.blocks import BLOCK
from gatelens.operators import cuts, depth, graph

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_flags_and_cutwidth_make_no_row_per_qubit(spark):
    edges = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 2, 1), (1, 0, 3, 1), (2, 1, 6, 1), (2, 2, 3, 1)], "file long, u int, v int, weight long")
    spine = spark.createDataFrame([(1, 4), (2, 4), (3, 2)], "file long, n_qubits int")
    flags = graph.topology_flags(edges, graph.edge_degrees(edges), spine)
    assert sorted(map(tuple, flags.collect())) == sorted(map(tuple, graph.topology_flags(edges, graph.degrees(edges, spine), spine).collect()))
    width = graph.cutwidth(graph.natural_order(edges), spine, "natural")
    profile = cuts.crossing_profile(graph.natural_order(edges), "lo", "hi", F.lit(1), spine)
    assert {r.file: r.graph_cutwidth_natural for r in width.collect()} == {**{r.file: r.m for r in profile.groupBy("file").agg(F.max("pressure").alias("m")).collect()}}
    assert "Union" not in _plan(flags) and "Union" not in _plan(width)


def test_graphs_of_small_circuits_need_no_positions(spark):
    from __spark_entry__ import queries
    assert "row_number" not in _plan(queries()["e17_topology_flags"](spark, SF)) and "Window" not in _plan(queries()["e17_topology_flags"](spark, SF))
    assert "seq" not in fx.v_gates_small(spark, SF, with_seq=False).columns


def test_layers_of_gates_without_operands_and_with_start_times():
    n, lists = 4, pa.list_(pa.int32())
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 1, 1, 2]), pa.array(np.array([0, 0, 1, 0])), pa.array([1, 2, 3, 1]), pa.array(["h", "cx", "cx", "h"]), pa.array([[0], [0, 1], [1, 2], None], lists),
         pa.array([None, None, [1, 2], None], lists), pa.array([None, None, [5, 9], None], pa.list_(pa.int64()))],
        ["file", BLOCK, "seq", "name", "qubits", "start_qubits", "start_times"])
    out = [x for b in depth._lay_out([batch.slice(0, 2), batch.slice(2, n)]) for x in b.column("layer").to_pylist()]
    assert out == [0, 1, 9, 0]


def test_fits_read_stored_rows(spark, monkeypatch):
    """Each fit reads its rows several times: they are a written table, not the answers of models worked out anew."""
    from gatelens.operators import models
    from gatelens.plans import training
    seen = []
    for kind in (models.ThresholdClassifier, models.RuntimeModel):
        def fit(self, train, val=None, whole=kind.fit):
            seen.extend(_plan(x) for x in (train, val))
            return whole(self, train, val)
        monkeypatch.setattr(kind, "fit", fit)
    rows = [(i, float(i % 7), float(i % 5), "CPU", "single", float(2 ** (i % 3)), 1.0 + i % 7, (i % 10) / 10) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, f0 double, f1 double, backend string, precision string, selected_threshold double, forward_wall_s double, fidelity_at_1 double")
    train, val = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    model = training.ThresholdPredictor(["f0", "f1"], 2, auxiliary_settings={"n_estimators": 2}, classifier={"tree_counts": (2, 3)}).fit(train, val)
    out = training.RuntimePredictor(model, settings={"use_ensemble": False, "max_iter": 2}).fit(train, val).predict(df)
    assert len(seen) == 4 and all(p.startswith("Relation") for p in seen) and out.count() == 120


def test_one_fold_copies_one_fold(spark):
    """What is asked for the first fold only is made for it only, with the same rows as for all folds."""
    from gatelens.catalog import models as queries
    from gatelens.catalog.learning import baseline_out_of_fold
    from gatelens.functions.lineage import cut
    from gatelens.operators import splits
    df = cut(fx.v_features(spark, SF))
    one, every = queries._parts_of(df, False, [0]), queries._parts_of(df, False)
    ids = lambda part: sorted(r.id for r in part.select("id").collect())
    assert [ids(p) for p in one(0)] == [ids(p) for p in every(0)] and sum(len(ids(p)) for p in one(0)) == df.count()
    assert all(p.count() == 0 for p in one(1))
    folded = cut(splits.group_kfold(df, "grp", 5))
    answers = lambda out: sorted((r.id, r.predicted_threshold_min, r.predicted_forward_wall_s) for r in out.where("fold = 0").collect())
    first = baseline_out_of_fold(folded, [0])
    assert first.where("fold <> 0").count() == 0 and answers(first) == answers(baseline_out_of_fold(folded))
