"""Gradient-boosted trees, one Spark ML regressor per horizon, with early stopping on validation rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.models.base import FittedForecaster, Forecaster, prediction_names
from tapewright.models.spaces import Choice, Steps, Uniform, When
from tapewright.operators.columns import split_types
from tapewright.operators.prep import Fill, Inputs, fill_values, imputed, target_scale
from tapewright.session import stage

# Objective names and the losses of the regressor that they stand for.
LOSSES = {"reg:squarederror": "squared", "reg:absoluteerror": "absolute"}
#: Depth of trees without a limit, which the regressor does not know; ``ignored`` reports it.
UNLIMITED = 8
IGNORED = ("reg_alpha", "reg_lambda", "grow_policy", "max_leaves", "tree_method", "eval_metric")


@dataclass(frozen=True)
class BoostedTrees(Forecaster):
    """Parameters keep their usual names; those without a counterpart are listed by ``ignored``."""

    horizon: int = 1
    seed: int = 42
    n_estimators: int = 400
    learning_rate: float = 0.05
    max_depth: int = 5
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    min_child_weight: float = 1.0
    gamma: float = 0.0
    max_bin: int = 128
    objective: str = "reg:squarederror"
    early_stopping_rounds: int = 30
    parallel_fits: int = 2
    extra: dict[str, Any] = field(default_factory=dict)
    name = "xgboost"

    def with_params(self, **params: Any) -> BoostedTrees:
        known = {k: v for k, v in params.items() if k in asdict(self)}
        rest = {k: v for k, v in params.items() if k in IGNORED}
        return replace(self, **known, extra={**self.extra, **rest})

    def ignored(self) -> dict[str, Any]:
        """Parameters that were given and have no effect here, or another one: trees without a limit get a deepest depth."""
        return {**self.extra, **({} if self.max_depth else {"max_depth": 0})}

    @classmethod
    def search_space(cls) -> dict[str, Any]:
        # Ranges of the tuned parameters.
        return {
            "n_estimators": Steps(400, 1200, 200),
            "learning_rate": Uniform(0.02, 0.1, log=True),
            "grow_policy": Choice(("depthwise", "lossguide")),
            "max_depth": When(lambda p: p["grow_policy"] == "lossguide", 0, Steps(3, 8)),
            "max_leaves": When(lambda p: p["grow_policy"] == "lossguide", Steps(64, 512, 64), 0),
            "subsample": Uniform(0.6, 1.0),
            "colsample_bytree": Uniform(0.6, 1.0),
            "min_child_weight": Uniform(0.5, 10.0),
            "reg_alpha": Uniform(0.0, 1.0),
            "reg_lambda": Uniform(0.1, 5.0),
            "early_stopping_rounds": 100,
            "max_bin": Steps(128, 512, 64),
            "objective": Choice(("reg:squarederror", "reg:absoluteerror")),
            "eval_metric": Choice(("rmse", "mae")),
            "tree_method": "hist",
        }

    def _regressor(self, j: int) -> GBTRegressor:
        return GBTRegressor(
            featuresCol="_vector", labelCol=f"_y{j}", predictionCol=f"_p{j}", seed=self.seed + j,
            maxIter=self.n_estimators, stepSize=self.learning_rate, maxDepth=self.max_depth or UNLIMITED,
            subsamplingRate=self.subsample, featureSubsetStrategy=str(float(self.colsample_bytree)),
            minInstancesPerNode=max(1, round(self.min_child_weight)), minInfoGain=self.gamma,
            maxBins=int(self.max_bin), lossType=LOSSES[self.objective],
        )

    def fit(self, train: DataFrame, features: Sequence[str], targets: Sequence[str], val: DataFrame | None = None) -> FittedTrees:
        inputs = Inputs.of(*split_types(features))
        known = train.na.drop(subset=list(targets))
        fill = fill_values(known, inputs)
        scale = {r["target"]: (r["mean"], r["std"]) for r in target_scale(known, targets).collect()}
        rows = known.withColumn("_val", F.lit(False))
        if val is not None and self.early_stopping_rounds > 0:
            rows = rows.unionByName(val.na.drop(subset=list(targets)).withColumn("_val", F.lit(True)))
        labels = [((F.col(t) - scale[t][0]) / scale[t][1]).alias(f"_y{j}") for j, t in enumerate(targets)]
        encoded = fill.attach(rows).select("_val", *labels, *imputed(inputs))
        # every horizon reads the same encoded rows, many times: write them once
        data = _vectors(stage(encoded, "tree-input"), inputs)
        stop = val is not None and self.early_stopping_rounds > 0

        def one(j: int) -> GBTRegressionModel:
            model = self._regressor(j).fit(data.where("NOT _val").select("_vector", f"_y{j}"))
            if not stop:
                return model
            losses = model.evaluateEachIteration(data.where("_val").select("_vector", f"_y{j}"), LOSSES[self.objective])
            return first_trees(model, best_round(losses, self.early_stopping_rounds))

        if self.parallel_fits > 1 and len(targets) > 1:
            with ThreadPool(self.parallel_fits) as pool:
                models = pool.map(one, range(len(targets)))
        else:
            models = [one(j) for j in range(len(targets))]
        return FittedTrees(models, inputs, fill, [scale[t] for t in targets])


def best_round(losses: Sequence[float], patience: int) -> int:
    """Rounds to keep: the best one before ``patience`` rounds have gone by without a better one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_trees(model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model of the first rounds: later trees do not change earlier ones."""
    if rounds >= model.getNumTrees:
        return model
    java, context = model._java_obj, SparkSession.active().sparkContext
    gateway = context._gateway
    trees = gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(java.trees(), java.treeWeights(), strict=True)):
        if i < rounds:
            trees[i], weights[i] = tree, weight
    cut = context._jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    return _with_columns(GBTRegressionModel(cut), model)


def _with_columns(cut: GBTRegressionModel, model: GBTRegressionModel) -> GBTRegressionModel:
    cut._java_obj.setFeaturesCol(model.getFeaturesCol())
    cut._java_obj.setPredictionCol(model.getPredictionCol())
    cut._transfer_params_from_java()
    return cut


def _vectors(df: DataFrame, inputs: Inputs) -> DataFrame:
    return VectorAssembler(inputCols=inputs.encoded, outputCol="_vector").transform(df)


@dataclass(frozen=True)
class FittedTrees(FittedForecaster):
    models: list[GBTRegressionModel]
    inputs: Inputs
    fill: Fill
    scale: list[tuple[float, float]]
    scope: tuple[str, ...] = ()

    @property
    def horizon(self) -> int:
        return len(self.models)

    def transform(self, df: DataFrame) -> DataFrame:
        filled = self.fill.attach(df)
        enc = self.inputs.encoded
        inner = filled.withColumns({f"_x_{n}": c for n, c in zip(enc, imputed(self.inputs))})
        out = VectorAssembler(inputCols=[f"_x_{n}" for n in enc], outputCol="_vector").transform(inner)
        for j, model in enumerate(self.models):
            out = model.transform(out)
        names = prediction_names(self.horizon)
        preds = {n: F.col(f"_p{j}") * self.scale[j][1] + self.scale[j][0] for j, n in enumerate(names)}
        return out.withColumns(preds).drop("medians", "modes", "_vector", *[f"_x_{n}" for n in enc], *[f"_p{j}" for j in range(self.horizon)])

    def importances(self) -> list[tuple[int, str, float]]:
        """(horizon, feature, gain importance)."""
        return [(j + 1, n, float(v)) for j, m in enumerate(self.models) for n, v in zip(self.inputs.encoded, m.featureImportances.toArray())]

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        info = spark.createDataFrame(
            [(list(self.inputs.numeric), list(self.inputs.categorical), list(self.fill.medians), list(self.fill.modes), [list(s) for s in self.scale])],
            "numeric array<string>, categorical array<string>, medians array<double>, modes array<int>, scale array<array<double>>",
        )
        info.write.mode("overwrite").parquet(f"{path}/info")
        for j, m in enumerate(self.models):
            m.write().overwrite().save(f"{path}/horizon={j + 1}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedTrees:
        row = spark.read.parquet(f"{path}/info").first()
        models = [GBTRegressionModel.load(f"{path}/horizon={j + 1}") for j in range(len(row["scale"]))]
        return FittedTrees(models, Inputs.of(row["numeric"], row["categorical"]), Fill(medians=tuple(row["medians"]), modes=tuple(row["modes"])), [tuple(s) for s in row["scale"]])
