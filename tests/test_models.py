"""Small fits: the models learn, persist and compose."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.operators import decisions, frame, models, splits
from gatelens.plans import training

FEATS = ["f0", "f1"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        a, b = float(rng.uniform(0, 4)), float(rng.normal())
        wall = float(np.exp(a) * (1 + 0.05 * rng.normal()) + 1)
        curve = [float(np.clip(0.2 + 0.25 * (j - a + 1), 0, 1)) for j in range(3)]
        rows.append((i, i // 6, a, b, "CPU" if i % 2 else "GPU", "single", float(2 ** int(a)), wall, wall * 0.1, wall * 0.9 / 10000, "GHZ", *curve, curve[0]))
    schema = ("id long, grp long, f0 double, f1 double, backend string, precision string, selected_threshold double, forward_wall_s double, "
              "estimated_setup_s double, estimated_per_shot_s double, predicted_family string, sweep_fid_1 double, sweep_fid_2 double, sweep_fid_4 double, fidelity_at_1 double")
    return spark.createDataFrame(rows, schema).cache()


def test_threshold_predictor_and_artifacts(data, spark, tmp_path):
    fitted = training.ThresholdPredictor(FEATS, 3, classifier={"tree_counts": (5, 10), "max_depth": 4}).fit(data, data.where("id < 60"))
    out = fitted.predict(data)
    score = training.mean_threshold_score(out)
    assert score > 0.7 and out.where("predicted_threshold_min < 2").count() == 0  # the family's floor is 2
    assert "pred_fidelity_at_1" in out.columns
    models.save_model(fitted.model, str(tmp_path / "m"), spark)
    again = models.load_model(models.ThresholdClassifier, str(tmp_path / "m"), spark)
    key = lambda df: sorted(tuple(r) for r in df.select("id", "predicted_threshold_min").collect())
    ready = fitted.enrich(data)
    assert key(again.predict(ready)) == key(fitted.model.predict(ready))


def test_boosted_classifier(data, spark, tmp_path):
    """One ensemble per rung, stopped early: as good as the forest on held-out groups, and nine probabilities that sum to one."""
    train, val, test = data.where("grp % 5 > 1"), data.where("grp % 5 = 1"), data.where("grp % 5 = 0")
    loss = {}
    for method, settings in (("boost", {"max_rounds": 15, "max_depth": 3}), ("forest", {"tree_counts": (5, 10)})):
        model = models.ThresholdClassifier(FEATS, method=method, **settings).fit(train, val)
        rows = model.predict_proba(test).collect()
        assert all(sum(r.proba) == pytest.approx(1) and len(r.proba) == 9 for r in rows)
        loss[method] = -np.mean([np.log(max(r.proba[int(np.log2(r.selected_threshold))], 1e-6)) for r in rows])
    assert loss["boost"] < max(1.2 * loss["forest"], 0.5)


def test_scaler_per_rung(spark):
    rows = [(float(i), 0.5 if i < 10 else None, 0.1) for i in range(100)]
    df = spark.createDataFrame(rows, "f0 double, sweep_fid_1 double, sweep_fid_2 double")
    model = models.KernelCurveModel(["f0"], rungs=[1, 2]).fit(df, {1: "sweep_fid_1", 2: "sweep_fid_2"})
    assert [model.scalers[r][0][0] for r in (1, 2)] == [4.5, 49.5]


def test_curves(data):
    columns = {1: "sweep_fid_1", 2: "sweep_fid_2", 4: "sweep_fid_4"}
    rows = decisions.curve_weights(frame.expand_rungs(data, columns, ["id", *FEATS]), ["id"], [1, 2, 4])
    pooled = models.CurveModel(FEATS, max_iter=5, rungs=[1, 2, 4]).fit(rows)
    assert pooled.predict_threshold(data, ["id"]).count() == 240
    low = pooled.predict_curve(data).join(rows.select("id", "rung", F.col("y").alias("seen")), ["id", "rung"])
    assert 0.05 < low.agg(F.avg((F.col("seen") < F.col("y")).cast("int"))).first()[0] < 0.4  # about one sixth lies below
    for cls in (models.AdditiveCurveModel, models.KernelCurveModel):
        wide = cls(FEATS, rungs=[1, 2, 4, 8]).fit(data, columns).predict_wide(data)
        assert wide.where("curve_1 > curve_2 OR curve_2 > curve_4 OR curve_4 <> curve_8").count() == 0
        err = wide.agg(F.avg(F.abs(F.col("curve_2") - F.col("sweep_fid_2")))).first()[0]
        assert err < 0.1


def test_runtime(data):
    held = data.where("id % 4 = 0")
    fitted = models.RuntimeModel(FEATS, max_iter=4, max_depth=3).fit(data.where("id % 4 <> 0"), held)
    assert fitted.weights is not None and fitted.calibration is not None
    assert training.mean_runtime_score(fitted.predict(held, "selected_threshold")) > -0.8
    parts = fitted.predict_decomposed(held, "selected_threshold").first()
    assert parts.setup_s > 0 and parts.total_s > parts.setup_s
    with pytest.raises(ValueError):
        models.KernelRuntimeModel(FEATS, "none").fit(data)


def test_search(data):
    parts = splits.build_splits(data, "id", "grp", 2)

    def fit_predict(train, val, test, params):
        return models.KernelRuntimeModel(FEATS, **params).fit(train).predict(test, "selected_threshold")

    grid = training.param_grid({"scaling": ["none", "standard"]})
    best, score, tried = training.grouped_param_search(data, parts, "id", 2, fit_predict, grid, training.mean_runtime_score)
    assert best == {"scaling": "standard"} and score > -1.0 and tried[0][1] == float("-inf")
    assert tried[0][2] == "unknown scaler 'none'" and tried[1][2] is None


def test_halving(spark):
    """The better half goes on to more folds; failures keep their reason; ties go to the earlier candidate."""
    calls = []
    folds = lambda k: (None, None, spark.createDataFrame([(k,)], "fold int"))

    def fit_predict(train, val, test, settings):
        calls.append((settings["name"], test.first().fold))
        if settings.get("fails"):
            raise ValueError("no such model")
        return test.withColumn("score", F.lit(settings["score"]))

    candidates = [{"name": n, "score": s} for n, s in (("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", 3.0))] + [{"name": "e", "score": 9.0, "fails": True}]
    tried = training.halving_search(folds, 5, fit_predict, candidates, lambda df: df.agg(F.avg("score")).first()[0])
    assert [(t.settings["name"], t.folds) for t in tried] == [("b", 5), ("d", 2), ("c", 1), ("a", 1), ("e", 0)]
    assert tried[-1].reason == "no such model" and sorted(calls).count(("b", 0)) == 1 and len(calls) == 5 + 2 + 3


def test_kinds_of_candidates(data):
    predict = training.runtime_candidate(FEATS)
    train, test = data.where("grp % 4 > 0"), data.where("grp % 4 = 0")
    score = {}
    for settings in ({"kind": "kernel"}, {"kind": "linear", "n_features": 1}, {"kind": "bucket"}, {"kind": "boost", "max_iter": 3}, {"kind": "kernel", "margin": 50.0}):
        score[str(settings)] = training.mean_runtime_score(predict(train, None, test, settings))
    assert score["{'kind': 'kernel'}"] >= max(score.values()) - 0.05 and score["{'kind': 'kernel', 'margin': 50.0}"] == min(score.values())
    with pytest.raises(ValueError, match="unknown kind"):
        predict(train, None, test, {"kind": "none"})


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), float(x), float(w)) for g, x, w in zip(rng.integers(0, 3, 500), np.round(rng.uniform(-1, 1, 500), 2), rng.uniform(0.1, 3, 500))]
    got = {r.g: (r.n, r.q) for r in models.weighted_quantiles(spark.createDataFrame(rows, "g int, x double, weight double").repartition(4), "g", 0.2, blocks=16).collect()}
    for g in range(3):
        own = sorted((x, w) for k, x, w in rows if k == g)
        upto, total = np.cumsum([w for _, w in own]), sum(w for _, w in own)
        assert got[g] == (len(own), own[int(np.argmax(upto >= 0.2 * total))][0])


def test_quantile_follows_the_spread(spark):
    """Noise grows with f0; one shift for all would cover far too little of the noisy rows."""
    rng = np.random.default_rng(5)
    rows = [(i, float(a), 1, 0.0, float(np.clip(0.5 + (0.02 + 0.4 * (a > 0.5)) * rng.uniform(-1, 1), 0, 1)), 1.0) for i, a in enumerate(rng.uniform(0, 1, 1500))]
    df = spark.createDataFrame(rows, "id long, f0 double, rung int, log2_rung double, y double, weight double")
    train, val, test = df.where("id < 700"), df.where("id >= 700 AND id < 1100"), df.where("id >= 1100")
    model = models.CurveModel(["f0"], max_iter=3, rungs=[1]).fit(train, val)
    low = model.predict_curve(test.select("id", "f0")).join(test.select("id", F.col("y").alias("seen")), "id")
    share = {r.noisy: r.share for r in low.groupBy((F.col("f0") > 0.5).alias("noisy")).agg(F.avg((F.col("seen") < F.col("y")).cast("int")).alias("share")).collect()}
    assert all(abs(s - 1 / 6) < 0.08 for s in share.values())


def test_folds_are_fitted_side_by_side_on_rows_of_all_tasks(spark):
    import threading

    from gatelens.catalog import models as queries
    from gatelens.plans import training

    gate = threading.Barrier(2, timeout=30)
    assert training.side_by_side(lambda k: (gate.wait() >= 0, k)[1], [3, 1]) == [3, 1]
    train, _, _ = queries._folds(spark, "/root/testdata/sf0.001", fill=False)(0)
    assert len(train.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_m22_does_all_folds(spark, monkeypatch):
    """Rows of every fold are made and fitted, with the models' own numbers of rounds, and the SQL asks for every fold."""
    from gatelens import catalog
    from gatelens.catalog import models as queries

    asked = {}
    rows = spark.createDataFrame([(i, i) for i in range(10)], "id long, grp long")
    monkeypatch.setattr(queries.fx, "v_features", lambda *_: rows)
    monkeypatch.setattr(queries, "_sweep_labels", lambda *_: rows.select("id", *[F.lit(0.5).alias(c) for c in queries.LABELS]))
    monkeypatch.setattr(queries, "_parts_of", lambda df, fill, folds, copied: asked.update(parts=list(folds)))
    monkeypatch.setattr(queries, "_out_of_fold", lambda parts, predict, folds: asked.update(predict=predict, folds=list(folds)))
    monkeypatch.setattr(queries, "_runtime_quality", lambda rows, out, others=(), folds=range(5): list(folds))
    assert queries.m22(spark, "") == asked["parts"] == asked["folds"] == [0, 1, 2, 3, 4]
    assert "fold = 0" not in catalog.ORACLES["m22_runtime_with_uncertainty"]
    made = {}
    monkeypatch.setattr(training.ThresholdPredictor, "fit", lambda self, train, val: made.update(threshold=self) or self)
    monkeypatch.setattr(training.RuntimePredictor, "fit", lambda self, train, val: made.update(runtime=self) or self)
    monkeypatch.setattr(training.RuntimePredictor, "predict", lambda self, df: df.withColumn("predicted_forward_wall_s", F.lit(1.0)))
    asked["predict"](rows, rows, rows)
    assert made["threshold"].auxiliary_settings == {} and made["runtime"].settings == {}


def test_rows_are_stored_once_for_all_folds(data, spark):
    """A row is not copied to its folds, and each fold's parts are those of the splits; a fold's medians are asked for once."""
    from gatelens.catalog import models as queries

    parts = queries._parts_of(data, False)
    assert parts.stored.count() == parts.n_rows == 240
    want = {}
    for r in splits.build_splits(data, "id", "grp", 5).collect():
        want.setdefault((r.fold, r.role), []).append(r.row_key)
    copied = queries._parts_of(data, False, range(5), True)
    assert copied.stored.count() == 1200 and copied.n_rows == 240
    for k in range(5):
        for role, own in [*zip(("train", "val", "test"), parts(k)), *zip(("train", "val", "test"), copied(k))]:
            assert own.columns == data.columns and sorted(r.id for r in own.collect()) == sorted(want[k, role])


def test_many_rows_are_fitted_one_by_one():
    import time

    under_way, most = [], []

    def work(k):
        under_way.append(k)
        most.append(len(under_way))
        time.sleep(0.05)
        under_way.remove(k)

    training.side_by_side(work, range(4), training.ROWS_AT_ONCE)
    assert max(most) == 1


def test_candidates_share_a_fold_s_rows(data, monkeypatch):
    """Candidates of a search write no copy of the train rows and ask for no medians of rows without gaps."""
    def none(*_):
        raise AssertionError("rows are written or medians asked for anew")

    monkeypatch.setattr(training, "cut", none)
    monkeypatch.setattr(training.frame, "fit_fill", none)
    out = training.runtime_candidate(FEATS, filled=True)(data.where("grp % 4 > 0"), None, data.where("grp % 4 = 0"), {"kind": "kernel"})
    assert out.count() == data.where("grp % 4 = 0").count()
