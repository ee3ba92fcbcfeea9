"""Gaussian-kernel regression whose kernel is learned: constant x Gaussian + white noise, through random Fourier features.

For each length scale of a short list a row's features are sqrt(2/D) cos(w x / scale + b). One pass sums the features' Gram matrix, their
products with the target and the target's moments per (target, scale, fold); all of it is additive. So a fold's train part is the total
minus the fold, and all folds come from the same pass. The driver gets D x D numbers per slot. There the evidence (marginal
likelihood) is maximised over scale and noise: with the Gram's eigenvalues it is a sum of D terms for each noise ratio, and
the constant and the noise follow in closed form. Inputs are scaled alike for all folds; scaling sees no target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelens.functions.exprs import d, finite

#: Length scales tried, in units of scaled inputs.
SCALES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
#: Ratios of noise to constant tried.
RATIOS = np.logspace(-6, 4, 61)
#: Partial sums that one task adds up.
FAN_IN = 256


@dataclass
class Fourier:
    """Random directions and phases; the same for every scale."""

    n_inputs: int
    n_components: int = 128
    seed: int = 42

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        self.w = rng.normal(0.0, 1.0, (self.n_inputs, self.n_components))
        self.b = rng.uniform(0.0, 2 * np.pi, self.n_components)

    def of(self, x: np.ndarray, scale: float) -> np.ndarray:
        return np.sqrt(2.0 / self.n_components) * np.cos(x @ self.w / scale + self.b)


def input_scaling(df: DataFrame, inputs: list[str], targets: list[Column], kind: str) -> list[tuple[list[float], list[float]]]:
    """(centre, width) of the inputs over each target's rows: mean and sample deviation, or median and quartile range."""
    if kind not in ("standard", "robust"):
        raise ValueError(f"unknown scaler {kind!r}")
    cells = []
    for t in targets:
        for c in inputs:
            x = F.when(t.isNotNull(), d(F.col(c)))
            cells += [F.avg(x), F.stddev(x)] if kind == "standard" else [F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000)]
    values, out = list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()), []
    for _ in targets:
        own = values[:len(inputs) * (2 if kind == "standard" else 1)]
        values = values[len(own):]
        if kind == "standard":
            centre, width = own[::2], own[1::2]
        else:
            centre, width = [q[1] if q else None for q in own], [q[2] - q[0] if q else None for q in own]
        out.append(([c or 0.0 for c in centre], [w or 1.0 for w in width]))
    return out


def _packed(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """n, sum y, sum y^2, sums of the features, their products with y, and the Gram's upper triangle."""
    upper = np.triu_indices(z.shape[1])
    return np.concatenate([[len(y), y.sum(), y @ y], z.sum(axis=0), z.T @ y, (z.T @ z)[upper]])


def _sum_of(table: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(s) for s in table["s"].to_pylist()], axis=0)
    kept = [table[c].slice(0, 1) for c in table.column_names if c != "s"]
    return pa.table([*kept, pa.array([total.tolist()], pa.list_(pa.float64()))], names=[*[c for c in table.column_names if c != "s"], "s"])


def grams(df: DataFrame, inputs: list[str], targets: list[Column], fold: Column, scaling: list, fourier: Fourier,
          scales: tuple[float, ...] = SCALES) -> dict[tuple[int, int, int], np.ndarray]:
    """(target, scale number, fold) -> packed sums, in one pass over the rows; rows without a target count for the others only."""
    rows = df.select(fold.cast("int").alias("fold"), F.array(*[d(F.col(c)) for c in inputs]).alias("x"), F.array(*targets).alias("y"))
    scaling = [(np.array(c), np.array(w)) for c, w in scaling]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            folds = batch.column("fold").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            for t, (centre, width) in enumerate(scaling):
                known = np.isfinite(y[:, t])
                if not known.any():
                    continue
                scaled = (x[known] - centre) / width
                if not np.isfinite(scaled).all():
                    raise ValueError("an input has no finite value; fill gaps first")
                for k, scale in enumerate(scales):
                    z = fourier.of(scaled, scale)
                    for f in np.unique(folds[known]):
                        own = folds[known] == f
                        part = _packed(z[own], y[known, t][own])
                        key = (t, k, int(f))
                        total[key] = total[key] + part if key in total else part
        part = TaskContext.get().partitionId()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()), pa.array([k[2] for k in total], pa.int32()),
                                              pa.array([part] * len(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                                             ["target", "scale", "fold", "part", "s"])

    parts = rows.mapInArrow(run, "target int, scale int, fold int, part long, s array<double>")
    key, kinds = ["target", "scale", "fold"], "target int, scale int, fold int"
    tasks = df.rdd.getNumPartitions()
    if tasks > FAN_IN:
        parts = parts.withColumn("part", F.col("part") % (tasks // FAN_IN + 1)).groupBy(*key, "part").applyInArrow(_sum_of, f"{kinds}, part long, s array<double>")
    found = parts.drop("part").groupBy(*key).applyInArrow(_sum_of, f"{kinds}, s array<double>")
    return {(r["target"], r["scale"], r["fold"]): np.array(r["s"]) for r in found.collect()}


def fit_evidence(sums: list[np.ndarray], scales: tuple[float, ...], n_components: int) -> dict | None:
    """The scale and noise of greatest evidence and their weights; ``sums`` holds the packed sums of each scale."""
    best = None
    for scale, s in zip(scales, sums):
        n = float(s[0])
        if n < 2:
            continue
        size = n_components
        mean_y, mean_z = s[1] / n, s[3:3 + size] / n
        upper = np.triu_indices(size)
        gram = np.zeros((size, size))
        gram[upper] = s[3 + 2 * size:]
        gram = gram + np.triu(gram, 1).T - n * np.outer(mean_z, mean_z)
        product = s[3 + size:3 + 2 * size] - n * mean_z * mean_y
        spread = max(s[2] - n * mean_y * mean_y, 0.0)
        values, vectors = np.linalg.eigh(gram)
        values, turned = np.maximum(values, 0.0), vectors.T @ product
        left = np.maximum(spread - (turned ** 2 / (values + RATIOS[:, None])).sum(axis=1), 1e-12 * max(spread, 1e-12))
        noise = left / (n - 1)
        evidence = -0.5 * ((n - 1) * np.log(noise) + np.log1p(values / RATIOS[:, None]).sum(axis=1) + n - 1)
        k = int(np.argmax(evidence))
        if best is None or evidence[k] > best["evidence"]:
            weights = vectors @ (turned / (values + RATIOS[k]))
            best = {"scale": float(scale), "noise": float(noise[k]), "constant": float(noise[k] / RATIOS[k]), "evidence": float(evidence[k]),
                    "weights": weights.tolist(), "intercept": float(mean_y - mean_z @ weights), "n": int(n)}
    return best


@dataclass
class KernelRegression:
    """Models of several targets over the same inputs; with folds, one per target and fold, each fitted on all other folds."""

    inputs: list[str]
    scaling_kind: str = "standard"
    scales: tuple[float, ...] = SCALES
    n_components: int = 128
    seed: int = 42
    scaling: list = field(default_factory=list)
    #: [target, fold or -1] with the fit, as plain numbers.
    fits: list = field(default_factory=list)

    def fit(self, df: DataFrame, targets: list[Column], fold: Column | None = None) -> KernelRegression:
        """``fold`` is a row's own fold, -1 and below not allowed; without it one model per target on all rows (-1)."""
        self.scaling = input_scaling(df, self.inputs, targets, self.scaling_kind)
        fourier = Fourier(len(self.inputs), self.n_components, self.seed)
        sums = grams(df, self.inputs, targets, F.lit(-1) if fold is None else fold, self.scaling, fourier, self.scales)
        self.fits = []
        for t in range(len(targets)):
            folds = sorted({f for i, _, f in sums if i == t})
            zero = np.zeros(3 + 2 * self.n_components + self.n_components * (self.n_components + 1) // 2)
            total = [sum((sums.get((t, k, f), zero) for f in folds), zero) for k in range(len(self.scales))]
            for f in folds:
                train = total if f == -1 else [whole - sums.get((t, k, f), zero) for k, whole in enumerate(total)]
                found = fit_evidence(train, self.scales, self.n_components)
                if found is not None:
                    self.fits.append([t, f, found])
        return self

    def of(self, target: int = 0, fold: int = -1) -> dict | None:
        return next((found for t, f, found in self.fits if t == target and f == fold), None)

    def predictions(self, fold: Column | None = None) -> Column:
        """array<double>: each target's prediction, NULL where the fold has no model."""
        fourier, scaling = Fourier(len(self.inputs), self.n_components, self.seed), [(np.array(c), np.array(w)) for c, w in self.scaling]
        models = {(t, f): (m["scale"], np.array(m["weights"]), m["intercept"]) for t, f, m in self.fits}

        def predict(folds: pd.Series, *columns: pd.Series) -> pd.Series:
            x, own = np.column_stack([c.to_numpy(float) for c in columns]), folds.to_numpy()
            if not np.isfinite(x).all():
                raise ValueError("an input has no finite value; fill gaps first")
            out = np.full((len(x), len(scaling)), np.nan)
            for t, (centre, width) in enumerate(scaling):
                for f in np.unique(own):
                    if (t, f) in models:
                        scale, weights, intercept = models[t, f]
                        rows = own == f
                        out[rows, t] = fourier.of((x[rows] - centre) / width, scale) @ weights + intercept
            return pd.Series(list(out))

        answer = F.pandas_udf(predict, "array<double>")(F.lit(-1) if fold is None else fold.cast("int"), *[d(F.col(c)) for c in self.inputs])
        return F.transform(answer, finite)
