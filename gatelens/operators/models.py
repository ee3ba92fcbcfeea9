"""Models on ``pyspark.ml``. Training and scoring are Spark jobs; only coefficients and column names are held here.

Boosting with early stopping, additive models and Gaussian processes are re-expressed with estimators that scale with
rows: tree ensembles, binned linear models, and random Fourier features whose kernel is learned (``kernels``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Bucketizer, OneHotEncoder, QuantileDiscretizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelens.constants import RUNGS_SCORING, TARGET_FIDELITY
from gatelens.functions.blocks import running_total
from gatelens.functions.exprs import d, finite, rung_log2
from gatelens.functions.joins import join_small
from gatelens.functions.lineage import cut
from gatelens.operators import decisions, kernels
from gatelens.operators.scoring import rung_index


def _assembler(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="error")


def _scored(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """Adds the model's prediction as ``out`` and drops its scratch columns."""
    return model.transform(df).withColumn(out, F.col("prediction")).select(*df.columns, out)


# ------------------------------------------------------------------ threshold classifier

@dataclass
class ThresholdClassifier:
    """M1 to M6: probability of each rung, then a risk-aware decision.

    ``method`` is ``forest`` (the ensemble size of the least validation log loss among ``tree_counts``) or ``boost``: one
    boosted ensemble per rung against the rest, each stopped when its validation loss no longer falls (at most
    ``max_rounds`` trees), with the nine probabilities scaled to sum to one.
    """

    features: list[str]
    method: str = "forest"
    max_depth: int = 5
    tree_counts: tuple[int, ...] = (20, 60)
    max_rounds: int = 1000
    learning_rate: float = 0.1
    policy: str = "expected_score"
    margin: float = 0.0
    seed: int = 42
    #: Train rows above the ladder, which count as its top rung.
    n_capped: int = 0
    model: PipelineModel | None = None
    boosted: dict[int, PipelineModel] = field(default_factory=dict)

    def _fit_boosted(self, data: DataFrame, val: DataFrame | None, label: Column) -> None:
        """A rung that no train row has gets probability 0."""
        rows = data.withColumn("is_val", F.lit(False))
        if val is not None:
            rows = rows.unionByName(val.withColumns({"label": label, "is_val": F.lit(True)}), allowMissingColumns=True)
        self.boosted = {}
        for k in sorted(int(r[0]) for r in data.select("label").distinct().collect()):
            tree = GBTClassifier(labelCol="own", maxIter=self.max_rounds, maxDepth=self.max_depth, stepSize=self.learning_rate, seed=self.seed)
            if val is not None:
                tree = tree.setValidationIndicatorCol("is_val")
            own = rows.withColumn("own", (F.col("label") == k).cast("double"))
            self.boosted[k] = Pipeline(stages=[_assembler(self.features), tree]).fit(own)

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> ThresholdClassifier:
        """With validation rows the ensemble size of the least log loss is kept, otherwise the largest."""
        label = F.least(rung_index(F.col("selected_threshold")), F.lit(len(RUNGS_SCORING) - 1)).cast("double")
        self.n_capped = train.where(F.col("selected_threshold") > RUNGS_SCORING[-1]).count()
        data = train.withColumn("label", label)
        if self.method == "boost":
            self._fit_boosted(data, val, label)
            return self
        sizes = self.tree_counts if val is not None else self.tree_counts[-1:]
        best = None
        for trees in sizes:
            forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=self.max_depth, seed=self.seed)
            model = Pipeline(stages=[_assembler(self.features), forest]).fit(data)
            loss = 0.0
            if val is not None:
                judge = MulticlassClassificationEvaluator(labelCol="label", metricName="logLoss")
                # a class that was never trained has no probability entry and cannot be judged
                known = val.withColumn("label", label).where(F.col("label") < model.stages[-1].numClasses)
                loss = judge.evaluate(model.transform(known))
            if best is None or loss < best[0]:
                best = (loss, model)
        self.model = best[1]
        return self

    def predict_proba(self, df: DataFrame, out: str = "proba") -> DataFrame:
        if self.method == "boost":
            scored = df
            for k, model in self.boosted.items():
                scored = model.transform(scored).withColumn(f"__p{k}", vector_to_array("probability")[1]).select(*scored.columns, f"__p{k}")
            raw = F.array(*[F.col(f"__p{k}") if k in self.boosted else F.lit(0.0) for k in range(len(RUNGS_SCORING))])
            total = F.greatest(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x), F.lit(1e-300))
            return scored.withColumn(out, F.transform(raw, lambda x: x / total)).select(*df.columns, out)
        n = self.model.stages[-1].numClasses
        padded = decisions.pad_probabilities(vector_to_array("probability"), list(range(n)))
        return self.model.transform(df).withColumn(out, padded).select(*df.columns, out)

    def predict(self, df: DataFrame, out: str = "predicted_threshold_min") -> DataFrame:
        p = F.col("proba")
        return self.predict_proba(df).withColumns({
            out: decisions.safety_margin(decisions.decide(p, self.policy), self.margin),
            "expected_index": decisions.expected_index(p), "threshold_entropy": decisions.entropy(p),
            "threshold_uncertainty": decisions.uncertainty(p)}).drop("proba")


# ------------------------------------------------------------------ auxiliary predictor

@dataclass
class AuxiliaryPredictor:
    """One regressor per sweep-derived target; adds pred_<target> columns."""

    features: list[str]
    n_estimators: int = 50
    max_depth: int = 3
    learning_rate: float = 0.1
    models: dict[str, PipelineModel] = field(default_factory=dict)

    def fit(self, df: DataFrame, targets: list[str] = decisions.AUXILIARY) -> AuxiliaryPredictor:
        present = [t for t in targets if t in df.columns]
        counts = df.agg(*[F.count(finite(t)).alias(t) for t in present]).first()
        for t in present:
            if counts[t] < 10:
                continue
            data = df.where(finite(t).isNotNull()).withColumn("label", decisions.auxiliary_forward(t))
            tree = GBTRegressor(maxIter=self.n_estimators, maxDepth=self.max_depth, stepSize=self.learning_rate, seed=42)
            self.models[t] = Pipeline(stages=[_assembler(self.features), tree]).fit(data)
        return self

    @property
    def names(self) -> list[str]:
        return [f"pred_{t}" for t in self.models]

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows that were enriched before get the columns anew."""
        df = df.drop(*self.names)
        for t, model in self.models.items():
            df = _scored(model, df, f"pred_{t}").withColumn(f"pred_{t}", decisions.auxiliary_inverse(t, F.col(f"pred_{t}")))
        return df


# ------------------------------------------------------------------ fidelity curves

def on_rungs(df: DataFrame, rungs: list[int] = RUNGS_SCORING) -> DataFrame:
    """Each row once per rung, with the rung and its log2."""
    return df.withColumn("rung", F.explode(F.array(*[F.lit(r) for r in rungs]))).withColumn("log2_rung", rung_log2(F.col("rung")))


def weighted_quantiles(rows: DataFrame, group: str, alpha: float, blocks: int = 1024) -> DataFrame:
    """(group, n, q): the least x at which the running weight reaches ``alpha`` of the group's. x is within -1 to 1; rows: group, x, weight."""
    block = F.floor((F.col("x") + 1) * (blocks / 2)).cast("long")
    summed = running_total(rows.groupBy(group, "x").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("c")), [group], block, ["x"], F.col("w"), "upto")
    totals = rows.groupBy(group).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    reached = join_small(summed, totals, [group]).where(F.col("upto") >= F.col("total") * (alpha - 1e-12))
    return reached.groupBy(group, "n").agg(F.min("x").alias("q"))


@dataclass
class CurveModel:
    """M8: pooled regression of a low quantile of fidelity on features and log2 rung.

    Boosting gives the mean (with validation rows it stops when their loss no longer falls). A tree on its residuals finds where they
    differ, and each of its leaves gets the exact weighted ``alpha``-quantile of the residuals that fall into it: validation residuals
    where there are any. Leaves with fewer than ``least_rows`` of them take the quantile of all residuals.
    """

    features: list[str]
    alpha: float = 1.0 / 6.0
    max_iter: int = 40
    max_depth: int = 5
    learning_rate: float = 0.1
    rungs: list[int] = field(default_factory=lambda: list(RUNGS_SCORING))
    leaf_depth: int = 4
    least_rows: int = 30
    model: PipelineModel | None = None
    leaves: PipelineModel | None = None
    #: Leaf number and its shift; -1 is the shift of the other leaves.
    shift: dict[int, float] = field(default_factory=dict)

    @property
    def inputs(self) -> list[str]:
        return [*self.features, "log2_rung"]

    def _in_leaves(self, df: DataFrame) -> DataFrame:
        """Adds the boosted mean ``raw`` and the number of the residual tree's leaf."""
        scored = _scored(self.model, df, "raw")
        return self.leaves.transform(scored).select(*scored.columns, F.col("leaf").cast("int").alias("leaf"))

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> CurveModel:
        """``train`` and ``val`` are expanded rows: features, log2_rung, rung, y, weight."""
        rows = train.withColumn("is_val", F.lit(False))
        if val is not None:
            rows = rows.unionByName(val.withColumn("is_val", F.lit(True)))
        data = rows.withColumn("label", F.least(F.greatest(F.col("y"), F.lit(1e-6)), F.lit(1.0)))
        tree = GBTRegressor(maxIter=self.max_iter, maxDepth=self.max_depth, stepSize=self.learning_rate, weightCol="weight", seed=42)
        if val is not None:
            tree = tree.setValidationIndicatorCol("is_val")
        self.model = Pipeline(stages=[_assembler(self.inputs), tree]).fit(data)
        left = _scored(self.model, train.where("y IS NOT NULL"), "raw").withColumn("label", F.abs(F.col("y") - F.col("raw")))
        spread = DecisionTreeRegressor(maxDepth=self.leaf_depth, minInstancesPerNode=self.least_rows, weightCol="weight", leafCol="leaf", seed=42)
        self.leaves = Pipeline(stages=[_assembler(self.inputs), spread]).fit(left)
        judged = self._in_leaves((val if val is not None else train).where("y IS NOT NULL"))
        residual = F.least(F.greatest(F.col("y") - F.col("raw"), F.lit(-1.0)), F.lit(1.0))
        found = cut(judged.select("leaf", residual.alias("x"), d(F.col("weight")).alias("weight")))
        both = found.unionByName(found.withColumn("leaf", F.lit(-1)))
        self.shift = {r.leaf: r.q for r in weighted_quantiles(both, "leaf", self.alpha).collect() if r.leaf == -1 or r.n >= self.least_rows}
        return self

    def predict_curve(self, df: DataFrame) -> DataFrame:
        """The rows once per rung with the predicted fidelity ``y``."""
        moved = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in self.shift.items() for x in kv]), F.col("leaf")), F.lit(self.shift.get(-1, 0.0)))
        scored = self._in_leaves(on_rungs(df, self.rungs))
        return scored.withColumn("y", F.least(F.greatest(F.col("raw") + moved, F.lit(0.0)), F.lit(1.0))).drop("raw", "log2_rung", "leaf")

    def predict_threshold(self, df: DataFrame, key: list[str], target: float = TARGET_FIDELITY) -> DataFrame:
        return decisions.curve_to_threshold(self.predict_curve(df), key, target)


class _PerRungCurve:
    """One regressor per rung; a rung without a model repeats the rung before it (the first one 0)."""

    rungs: list[int]
    features: list[str]
    models: dict[int, PipelineModel]

    def _estimator(self, train: DataFrame) -> Pipeline:
        raise NotImplementedError

    def _learn_inputs(self, df: DataFrame, rung: int) -> None:
        """Whatever a rung's inputs need to learn from that rung's rows."""

    def _prepare(self, df: DataFrame, rung: int) -> DataFrame:
        return df

    def fit(self, df: DataFrame, curve_columns: dict[int, str]) -> _PerRungCurve:
        counts = df.agg(*[F.count(finite(c)).alias(c) for c in curve_columns.values()]).first()
        self.models = {}
        for rung, c in curve_columns.items():
            if counts[c]:
                rows = df.where(finite(c).isNotNull()).withColumn("label", finite(c))
                self._learn_inputs(rows, rung)
                data = self._prepare(rows, rung)
                self.models[rung] = self._estimator(data).fit(data)
        return self

    def predict_wide(self, df: DataFrame) -> DataFrame:
        """Adds curve_<rung>, clipped and non-decreasing over the rungs."""
        out, before = df, F.lit(0.0)
        keep = list(df.columns)
        for rung in self.rungs:
            if rung in self.models:
                scored = self.models[rung].transform(self._prepare(out, rung)).withColumn(f"curve_{rung}", F.col("prediction"))
                out = scored.select(*out.columns, f"curve_{rung}")
                value = F.least(F.greatest(F.col(f"curve_{rung}"), F.lit(0.0)), F.lit(1.0))
            else:
                value = before
            out = out.withColumn(f"curve_{rung}", F.greatest(before, value))
            before = F.col(f"curve_{rung}")
        return out.select(*keep, *[f"curve_{r}" for r in self.rungs])

    def predict_threshold(self, df: DataFrame, out: str = "curve_threshold", target: float = TARGET_FIDELITY) -> DataFrame:
        return self.predict_wide(df).withColumn(out, self.answer(target)).select(*df.columns, out)

    def answer(self, target: float = TARGET_FIDELITY) -> Column:
        """The first rung whose curve reaches the target, else the last, over the columns of ``predict_wide``."""
        return F.coalesce(*[F.when(F.col(f"curve_{r}") >= target, F.lit(r)) for r in self.rungs], F.lit(self.rungs[-1]))


@dataclass
class AdditiveCurveModel(_PerRungCurve):
    """Per rung a sum of binned feature effects."""

    features: list[str]
    rungs: list[int] = field(default_factory=lambda: list(RUNGS_SCORING))
    bins: int = 8
    ridge: float = 0.01
    models: dict[int, PipelineModel] = field(default_factory=dict)

    def _estimator(self, train: DataFrame) -> Pipeline:
        binned = [f"{f}__bin" for f in self.features]
        cut = QuantileDiscretizer(inputCols=self.features, outputCols=binned, numBuckets=self.bins, handleInvalid="keep")
        hot = OneHotEncoder(inputCols=binned, outputCols=[f"{b}_hot" for b in binned], handleInvalid="keep")
        line = LinearRegression(regParam=self.ridge, elasticNetParam=0.0)
        return Pipeline(stages=[cut, hot, _assembler([f"{b}_hot" for b in binned]), line])

    def effects(self, rung: int) -> list[tuple[str, list[float], list[float]]]:
        """Explanation: per feature its bin edges and the effect of each bin."""
        stages = self.models[rung].stages
        bucketizer: Bucketizer = stages[0]
        coefficients = stages[-1].coefficients.toArray().tolist()
        out, at = [], 0
        for f, splits, size in zip(self.features, bucketizer.getSplitsArray(), stages[1].categorySizes):
            out.append((f, list(splits), coefficients[at:at + size]))
            at += size
        return out


@dataclass
class KernelCurveModel(_PerRungCurve):
    """Per rung a scaler and a Gaussian-kernel regression with learned scale and noise; uses all rows of the rung."""

    features: list[str]
    rungs: list[int] = field(default_factory=lambda: list(RUNGS_SCORING))
    n_components: int = 128
    scales: tuple[float, ...] = kernels.SCALES
    learned: list[int] = field(default_factory=list)
    regression: dict = field(default_factory=dict)

    def _kernel(self) -> kernels.KernelRegression:
        return kernels.KernelRegression(**self.regression)

    def fit(self, df: DataFrame, curve_columns: dict[int, str], fold: Column | None = None) -> KernelCurveModel:
        """``fold``: a row's own fold; each fold's curves then come from all other folds, all folds in one pass."""
        self.learned = list(curve_columns)
        kernel = kernels.KernelRegression(self.features, "standard", self.scales, self.n_components)
        self.regression = vars(kernel.fit(df, [finite(c) for c in curve_columns.values()], fold))
        return self

    @property
    def scalers(self) -> dict[int, tuple[list[float], list[float]]]:
        return dict(zip(self.learned, self.regression["scaling"]))

    def predict_wide(self, df: DataFrame, fold: Column | None = None) -> DataFrame:
        raw = df.withColumn("__raw", self._kernel().predictions(fold))
        keep, before = list(df.columns), F.lit(0.0)
        for rung in self.rungs:
            value = F.get("__raw", F.lit(self.learned.index(rung))) if rung in self.learned else F.lit(None).cast("double")
            # a rung without a model repeats the one before
            raw = raw.withColumn(f"curve_{rung}", F.greatest(before, F.coalesce(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), before)))
            before = F.col(f"curve_{rung}")
        return raw.select(*keep, *[f"curve_{r}" for r in self.rungs])


# ------------------------------------------------------------------ runtime

@dataclass
class RuntimeModel:
    """L1 boosting on log1p seconds with setup and per-shot heads, optional blend and calibration."""

    features: list[str]
    max_iter: int = 40
    max_depth: int = 5
    learning_rate: float = 0.1
    use_ensemble: bool = True
    use_calibration: bool = True
    heads: dict[str, PipelineModel] = field(default_factory=dict)
    weights: tuple[float, float, float] | None = None
    calibration: tuple[float, float] | None = None

    @property
    def inputs(self) -> list[str]:
        return [*self.features, "thr_log2"]

    def _with_threshold(self, df: DataFrame, threshold: str) -> DataFrame:
        return df.withColumn("thr_log2", rung_log2(F.col(threshold)))

    def _boost(self, data: DataFrame, column: str, loss: str = "absolute", depth: int | None = None, val: bool = False) -> PipelineModel:
        labelled = data.withColumn("label", F.log1p(d(F.col(column))))
        tree = GBTRegressor(lossType=loss, maxIter=self.max_iter, maxDepth=depth or self.max_depth, stepSize=self.learning_rate, seed=42)
        if val:
            tree = tree.setValidationIndicatorCol("is_val")
        return Pipeline(stages=[_assembler(self.inputs), tree]).fit(labelled)

    def fit(self, train: DataFrame, val: DataFrame | None = None, threshold: str = "selected_threshold") -> RuntimeModel:
        data = self._with_threshold(train, threshold).withColumn("is_val", F.lit(False))
        stop = val is not None
        if stop:
            checked = self._with_threshold(val, threshold).withColumn("is_val", F.lit(True))
            data = data.unionByName(checked, allowMissingColumns=True)
        self.heads = {"total": self._boost(data, "forward_wall_s", val=stop)}
        if {"estimated_setup_s", "estimated_per_shot_s"} <= set(train.columns):
            valid = data.where((finite("estimated_setup_s") > 0) & (finite("estimated_per_shot_s") > 0))
            n = valid.groupBy("is_val").count().collect()
            sizes = {r.is_val: r["count"] for r in n}
            if sizes.get(False, 0) > 10:
                early = stop and sizes.get(True, 0) > 5
                rows = valid if early else valid.where(~F.col("is_val"))
                self.heads["setup"] = self._boost(rows, "estimated_setup_s", val=early)
                self.heads["per_shot"] = self._boost(rows, "estimated_per_shot_s", val=early)
        if self.use_ensemble and stop:
            only = data.where(~F.col("is_val")).withColumn("label", F.log1p(d(F.col("forward_wall_s"))))
            self.heads["second"] = self._boost(only, "forward_wall_s", depth=min(self.max_depth + 1, 8))
            net = LinearRegression(regParam=0.002, elasticNetParam=0.2, standardization=True, maxIter=200)
            self.heads["linear"] = Pipeline(stages=[_assembler(self.inputs), net]).fit(only)
            judged = self._all_heads(checked)
            best = decisions.blend_search(judged, ["base_s", "second_s", "linear_s"], "forward_wall_s").first()
            self.weights = (best.w0, best.w1, best.w2)
        if self.use_calibration and stop:
            fit = decisions.log_calibration(self._blended(self._all_heads(checked)), "blend_s", "forward_wall_s").first()
            self.calibration = None if fit.slope is None else (fit.slope, fit.intercept)
        return self

    def _all_heads(self, df: DataFrame) -> DataFrame:
        out = df
        for name, model in self.heads.items():
            out = _scored(model, out, f"log_{name}_head")
        if "setup" in self.heads:
            base = decisions.combine_heads(F.col("log_setup_head"), F.col("log_per_shot_head"))
        else:
            base = decisions.safe_expm1(F.col("log_total_head"))
        out = out.withColumn("base_s", decisions.clip_runtime(base))
        for name in ("second", "linear"):
            if name in self.heads:
                out = out.withColumn(f"{name}_s", decisions.safe_expm1(F.col(f"log_{name}_head")))
        return out

    def _blended(self, df: DataFrame) -> DataFrame:
        if self.weights is None:
            return df.withColumn("blend_s", F.col("base_s"))
        parts = zip(("base_s", "second_s", "linear_s"), self.weights)
        return df.withColumn("blend_s", sum((F.col(c) * w for c, w in parts), F.lit(0.0)))

    def predict(self, df: DataFrame, threshold: str = "predicted_threshold_min", out: str = "predicted_forward_wall_s") -> DataFrame:
        blended = self._blended(self._all_heads(self._with_threshold(df, threshold)))
        slope, intercept = self.calibration or (None, None)
        total = decisions.apply_calibration(F.col("blend_s"), slope, intercept)
        return blended.withColumn(out, decisions.clip_runtime(total)).select(*df.columns, out)

    def predict_decomposed(self, df: DataFrame, threshold: str = "predicted_threshold_min") -> DataFrame:
        scored = self._all_heads(self._with_threshold(df, threshold))
        has = "setup" in self.heads
        setup, per_shot, total = decisions.runtime_decomposed(
            decisions.safe_expm1(F.col("log_total_head")), F.col("log_setup_head") if has else None, F.col("log_per_shot_head") if has else None)
        slope, intercept = self.calibration or (None, None)
        return scored.withColumns({"setup_s": setup, "per_shot_s": per_shot, "total_s": decisions.apply_calibration(total, slope, intercept)}).select(
            *df.columns, "setup_s", "per_shot_s", "total_s")


@dataclass
class KernelRuntimeModel:
    """Gaussian-kernel regression of log1p seconds with learned scale and noise; result at least 1e-9."""

    features: list[str]
    scaling: str = "standard"
    threshold_mode: str = "log2"
    n_components: int = 128
    scales: tuple[float, ...] = kernels.SCALES
    regression: dict = field(default_factory=dict)

    def _placed(self, df: DataFrame, threshold: str) -> tuple[DataFrame, list[str]]:
        extra = {"log2": ["thr_log2"], "raw": ["thr_raw"], "both": ["thr_log2", "thr_raw"]}[self.threshold_mode]
        values = {"thr_log2": rung_log2(F.col(threshold)), "thr_raw": d(F.col(threshold))}
        return df.withColumns({e: values[e] for e in extra}), [*self.features, *extra]

    def fit(self, train: DataFrame, threshold: str = "selected_threshold", fold: Column | None = None) -> KernelRuntimeModel:
        """``fold``: a row's own fold; each fold's model then comes from all other folds, all folds in one pass."""
        placed, inputs = self._placed(train.where(finite("forward_wall_s") > 0), threshold)
        kernel = kernels.KernelRegression(inputs, self.scaling, self.scales, self.n_components)
        self.regression = vars(kernel.fit(placed, [F.log1p(d(F.col("forward_wall_s")))], fold))
        return self

    def predict(self, df: DataFrame, threshold: str = "predicted_threshold_min", out: str = "predicted_forward_wall_s", fold: Column | None = None) -> DataFrame:
        placed, _ = self._placed(df, threshold)
        log = F.get(kernels.KernelRegression(**self.regression).predictions(fold), F.lit(0))
        return placed.withColumn(out, F.greatest(F.expm1(F.least(log, F.lit(700.0))), F.lit(1e-9))).select(*df.columns, out)


# ------------------------------------------------------------------ artifacts

def save_model(model, path: str, spark: SparkSession) -> None:
    """Every fitted pipeline in its own folder and the plain settings as one JSON line."""
    plain, pipelines = {}, []
    for name, value in vars(model).items():
        if isinstance(value, PipelineModel):
            pipelines.append((name, None, value))
        elif isinstance(value, dict) and value and all(isinstance(v, PipelineModel) for v in value.values()):
            pipelines += [(name, key, v) for key, v in value.items()]
        elif not isinstance(value, DataFrame):
            plain[name] = [[k, v] for k, v in value.items()] if isinstance(value, dict) else value
    for name, key, pipeline in pipelines:
        pipeline.write().overwrite().save(f"{path}/{name}" + ("" if key is None else f"/{key}"))
    sidecar = {"plain": plain, "pipelines": [[n, k] for n, k, _ in pipelines]}
    spark.createDataFrame([(json.dumps(sidecar),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_model(cls, path: str, spark: SparkSession):
    """The counterpart of ``save_model``."""
    sidecar = json.loads(spark.read.text(f"{path}/settings").first().value)
    settings = {}
    for name, value in sidecar["plain"].items():
        kind = str(cls.__dataclass_fields__[name].type)
        settings[name] = {k: v for k, v in value} if kind.startswith("dict") else tuple(value) if kind.startswith("tuple") and value else value
    model = cls(**settings)
    for name, key in sidecar["pipelines"]:
        loaded = PipelineModel.load(f"{path}/{name}" + ("" if key is None else f"/{key}"))
        if key is None:
            setattr(model, name, loaded)
        else:
            getattr(model, name)[key] = loaded
    return model


