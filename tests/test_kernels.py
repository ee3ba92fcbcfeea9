"""Kernel regression: evidence against a dense Gaussian process, folds by subtraction, learned against fixed scale."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelens.operators import kernels, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1, 20, 0.1] + [0, 5, 2]
    y = np.sin(2 * x[:, 0]) + 0.05 * x[:, 1] + 0.1 * rng.normal(size=600)
    other = np.where(np.arange(600) % 3 == 0, np.nan, x[:, 2])
    df = spark.createDataFrame([(i, i % 4, *map(float, v), float(a), None if np.isnan(b) else float(b), float(np.exp(a) + 1)) for i, (v, a, b) in enumerate(zip(x, y, other))],
                               "id long, fold int, a double, b double, c double, y double, other double, forward_wall_s double").repartition(5).cache()
    return df, x, y


def test_evidence_equals_the_dense_process(rows):
    _, x, y = rows
    fourier = kernels.Fourier(3, 16)
    z = fourier.of((x - x.mean(axis=0)) / x.std(axis=0, ddof=1), 2.0)
    found = kernels.fit_evidence([kernels._packed(z, y)], (2.0,), 16)
    zc, yc = z - z.mean(axis=0), y - y.mean()
    cover = found["constant"] * zc @ zc.T + found["noise"] * np.eye(len(y))
    sign, logdet = np.linalg.slogdet(cover)
    # the centred target has one dimension less
    dense = -0.5 * (logdet - np.log(found["noise"]) + yc @ np.linalg.solve(cover, yc))
    assert found["evidence"] == pytest.approx(dense, rel=1e-6)
    alone = np.linalg.solve(zc.T @ zc + found["noise"] / found["constant"] * np.eye(16), zc.T @ yc)
    assert np.allclose(found["weights"], alone, rtol=1e-5, atol=1e-7)


def test_folds_come_from_one_pass(rows, monkeypatch):
    df, _, _ = rows
    targets = [F.col("y"), F.col("other")]
    monkeypatch.setattr(kernels, "FAN_IN", 2)
    folded = kernels.KernelRegression(["a", "b", "c"]).fit(df, targets, F.col("fold"))
    assert sorted((t, f) for t, f, _ in folded.fits) == [(t, f) for t in (0, 1) for f in range(4)]
    for fold in range(4):
        alone = kernels.KernelRegression(["a", "b", "c"])
        alone.scaling = folded.scaling
        sums = kernels.grams(df.where(F.col("fold") != fold), alone.inputs, targets, F.lit(-1), alone.scaling, kernels.Fourier(3))
        for t in (0, 1):
            one = kernels.fit_evidence([sums[t, k, -1] for k in range(len(kernels.SCALES))], kernels.SCALES, 128)
            assert folded.of(t, fold)["scale"] == one["scale"] and folded.of(t, fold)["n"] == one["n"]
            assert np.allclose(folded.of(t, fold)["weights"], one["weights"], rtol=1e-4, atol=1e-5)


def test_learned_scale_beats_a_fixed_one(rows):
    df, _, _ = rows
    error = {}
    for scales in ((16.0,), (0.5,), kernels.SCALES):
        fitted = kernels.KernelRegression(["a", "b", "c"], scales=scales).fit(df, [F.col("y")], F.col("fold"))
        out = df.withColumn("p", F.get(fitted.predictions(F.col("fold")), F.lit(0)))
        error[scales] = out.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2))).first()[0]
    assert error[kernels.SCALES] <= min(error.values()) * 1.001 and error[kernels.SCALES] < 0.05


def test_few_rows_and_gaps(spark, rows):
    df, _, _ = rows
    none = kernels.KernelRegression(["a"]).fit(df.where("false"), [F.col("y")])
    assert none.fits == [] and df.select(F.get(none.predictions(), F.lit(0)).alias("p")).where("p IS NOT NULL").count() == 0
    same = kernels.KernelRegression(["a"]).fit(df.where("id = 1").unionByName(df.where("id = 1")), [F.col("y")])
    assert same.of()["n"] == 2 and np.isfinite(same.of()["intercept"])
    with pytest.raises(Exception, match="fill gaps"):
        kernels.KernelRegression(["other"]).fit(df, [F.col("y")])


def test_kept_models_predict_alike(spark, rows, tmp_path):
    df, _, _ = rows
    for cls, fit in ((models.KernelRuntimeModel, lambda m: m.fit(df.withColumn("selected_threshold", F.lit(4)))), (models.KernelCurveModel, lambda m: m.fit(df, {1: "y", 2: "other"}))):
        model = fit(cls(["a", "b", "c"]))
        models.save_model(model, str(tmp_path / cls.__name__), spark)
        again = models.load_model(cls, str(tmp_path / cls.__name__), spark)
        answer = (lambda m: m.predict(df.withColumn("selected_threshold", F.lit(4)), "selected_threshold")) if cls is models.KernelRuntimeModel else (lambda m: m.predict_wide(df))
        assert sorted(map(tuple, answer(model).drop("other").collect())) == sorted(map(tuple, answer(again).drop("other").collect()))
