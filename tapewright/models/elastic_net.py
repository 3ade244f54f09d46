"""Elastic net for H horizons at once, from Gram tables.

Objective per horizon: (1/2n) |y - Xw|^2 + alpha * l1 * |w|_1 + alpha * (1 - l1) / 2 * |w|^2 on
standardised numeric inputs, 0/1 one-hot inputs and standardised targets, with an intercept.

Spark makes one pass for the fill values and one for the cross products; then each model
(scope, fold, trial) is a row of a few kilobytes that a task solves.  No rows reach the
driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.models.base import FittedForecaster, Forecaster, prediction_names
from tapewright.models.spaces import Choice, Steps, Uniform
from tapewright.operators.columns import split_types
from tapewright.operators.gram import gram_table, unpack
from tapewright.operators.joins import join_models
from tapewright.operators.prep import Fill, Inputs, fill_values, imputed, literal
from tapewright.session import stage

PARTS = {"medians": "array<double>", "modes": "array<int>", "weights": "array<array<double>>", "bias": "array<double>"}


def minimise(q: np.ndarray, r: np.ndarray, n: float, alpha: float, l1: float, max_iter: int) -> np.ndarray:
    """Minimiser of the objective for one horizon, from centred cross products q = X'X, r = X'y.

    Feature-sign search: an active set with signs is grown one input at a time; on it the
    problem is a linear system, followed by a line search over the points where a sign flips.
    It ends at the exact optimum after about as many small solves as there are inputs.
    """
    p = len(r)
    soft, ridge = alpha * l1 * n, alpha * (1.0 - l1) * n
    usable = np.diag(q) > 1e-12 * max(1.0, n)
    # the floor only matters without a ridge, where it separates inputs that are exact copies
    h = q + max(ridge, 1e-10 * n) * np.eye(p)
    eps = 1e-9 * max(soft, 1e-6 * n)

    def objective(w: np.ndarray) -> np.ndarray:
        return 0.5 * np.einsum("...i,ij,...j", w, h, w) - w @ r + soft * np.abs(w).sum(axis=-1)

    w, sign = np.zeros(p), np.zeros(p)
    for _ in range(max_iter):
        grad = h @ w - r
        zero = usable & (w == 0)
        excess = np.where(zero, np.abs(grad) - soft, -np.inf)
        stuck = np.abs(grad + soft * np.sign(w))[w != 0].max(initial=0.0)
        if stuck <= eps:
            j = int(excess.argmax())
            if excess[j] <= eps:
                break
            sign[j] = -np.sign(grad[j])
        on = np.flatnonzero(sign)
        goal = np.zeros(p)
        goal[on] = np.linalg.solve(h[np.ix_(on, on)], r[on] - soft * sign[on])
        with np.errstate(divide="ignore", invalid="ignore"):
            crossing = np.where(w * goal < 0, w / (w - goal), np.nan)
        steps = np.append(np.unique(crossing[~np.isnan(crossing)]), 1.0)
        points = w + steps[:, None] * (goal - w)
        points[np.abs(crossing[None, :] - steps[:, None]) < 1e-15] = 0.0
        best = points[int(np.argmin(objective(points)))]
        if np.array_equal(best, w):
            break
        w = best
        sign = np.sign(w)
    return w


def standardised(gram: np.ndarray, p: int, numeric: int):
    """n, centred and scaled cross products, and the means and deviations used."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(centred), 0.0) / n)
    flat = std <= 1e-12 * np.maximum(1.0, np.abs(mean))
    std[flat] = 1.0
    std[numeric:p] = 1.0
    scaled = centred / np.outer(std, std)
    return n, scaled, mean, std


def fit_gram(gram: np.ndarray, p: int, numeric: int, alpha: float, l1_ratio: float, max_iter: int):
    """(weights per raw input and horizon, intercepts, weights on the standardised scale)."""
    n, scaled, mean, std = standardised(gram, p, numeric)
    q = scaled[:p, :p]
    w = np.column_stack([minimise(q, r, n, alpha, l1_ratio, max_iter) for r in scaled[:p, p:].T])
    raw = w / std[:p, None] * std[None, p:]
    return raw, mean[p:] - mean[:p] @ raw, w


def score_gram(gram: np.ndarray, p: int, raw: np.ndarray, intercept: np.ndarray) -> dict[str, float]:
    """Metrics pooled over rows and horizons, from cross products alone."""
    n, horizons = gram[0, 0], raw.shape[1]
    full = np.vstack([intercept[None, :], raw])
    a, b, y2 = gram[: p + 1, : p + 1], gram[: p + 1, p + 1:], np.diag(gram)[p + 1:]
    sse = float(np.sum(y2 - 2.0 * np.sum(full * b, axis=0) + np.sum(full * (a @ full), axis=0)))
    total = float(np.sum(y2) - np.sum(gram[0, p + 1:]) ** 2 / (n * horizons))
    mse = max(sse, 0.0) / (n * horizons)
    return {"mse": mse, "rmse": mse**0.5, "r2": 1.0 - sse / total if total > 0 else 0.0}


def spread(models: DataFrame, by: Sequence[str]) -> DataFrame:
    """Solving is compute bound and its rows are small, so adaptive coalescing must not put them into one task."""
    if not by:
        return models
    return models.repartition(max(8, models.sparkSession.sparkContext.defaultParallelism), *by)


def solve(models: DataFrame, scope: Sequence[str], trials: list[dict[str, Any]], p: int, numeric: int, metric: str) -> DataFrame:
    """Fit and score rows (scope..., trials, train, val): a row (scope..., trial, score) for each of the trials."""
    kinds = "".join(f"{c} {dict(models.dtypes)[c]}, " for c in scope)
    names = list(scope)
    plain = [(t["alpha"], t["l1_ratio"], int(t["max_iter"])) for t in trials]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scored = []
            for row in pdf.itertuples(index=False):
                dim = int((np.sqrt(8 * len(row.train) + 1) - 1) / 2)
                fit_on, score_on = unpack(row.train, dim), unpack(row.val, dim)
                for trial in row.trials:
                    raw, bias, _ = fit_gram(fit_on, p, numeric, *plain[trial])
                    scored.append((*[getattr(row, c) for c in names], int(trial), score_gram(score_on, p, raw, bias)[metric]))
            yield pd.DataFrame(scored, columns=[*names, "trial", "score"])

    return spread(models.select(*names, "trials", "train", "val"), [*names, "trials"]).mapInPandas(run, f"{kinds}trial int, score double")


@dataclass(frozen=True)
class ElasticNet(Forecaster):
    """``scope=()`` fits one model over all series, ``scope=("symbol",)`` one per series."""

    horizon: int = 30
    seed: int = 42
    alpha: float = 1e-3
    l1_ratio: float = 0.2
    selection: str = "cyclic"
    max_iter: int = 2000
    scope: tuple[str, ...] = ()
    name = "linreg"

    def with_params(self, **params: Any) -> ElasticNet:
        return replace(self, **{k: v for k, v in params.items() if k in asdict(self)})

    @classmethod
    def search_space(cls) -> dict[str, Any]:
        # Ranges of the tuned parameters (the defaults above are fixed as well).
        return {
            "alpha": Uniform(1e-5, 1e-2, log=True),
            "l1_ratio": Uniform(0.0, 1.0),
            "max_iter": Steps(1000, 4000, 500),
            "selection": Choice(("cyclic", "random")),
        }

    def grams(self, rows: DataFrame, inputs: Inputs, targets: Sequence[str], fill: Fill, group: Sequence[str] = ()) -> DataFrame:
        """Cross products of the imputed inputs, less their medians, and the targets, less their level, per scope and ``group``.

        Errors and r2 do not change with the level; sums of squares of large levels would hide them.
        """
        known = fill.attach(rows.na.drop(subset=list(targets)))
        return gram_table(known, [*self.scope, *group], imputed(inputs, shifted=True), [F.col(t).cast("double") - F.coalesce("target_level", F.lit(0.0)) for t in targets])

    def fit(self, train: DataFrame, features: Sequence[str], targets: Sequence[str], val: DataFrame | None = None, params: DataFrame | None = None) -> FittedElasticNet:
        """``params`` may hold (scope..., alpha, l1_ratio, max_iter) when every series has its own."""
        inputs = Inputs.of(*split_types(features))
        known = train.na.drop(subset=list(targets))
        fill = fill_values(known, inputs, self.scope, targets)
        grams = self.grams(known, inputs, targets, fill)
        if params is not None and self.scope:
            grams = join_models(grams, params.select(*self.scope, "alpha", "l1_ratio", "max_iter"), self.scope)
            grams = grams.withColumns({c: F.coalesce(c, F.lit(getattr(self, c))) for c in ("alpha", "l1_ratio", "max_iter")})
        else:
            grams = grams.withColumns({"alpha": F.lit(self.alpha), "l1_ratio": F.lit(self.l1_ratio), "max_iter": F.lit(self.max_iter)})
        p, numeric, names = len(inputs.encoded), len(inputs.numeric), list(self.scope)
        kinds = "".join(f"{c} {dict(grams.dtypes)[c]}, " for c in names)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                weights, biases, scaled = [], [], []
                for g, a, l1, it in zip(pdf["gram"], pdf["alpha"], pdf["l1_ratio"], pdf["max_iter"]):
                    dim = int((np.sqrt(8 * len(g) + 1) - 1) / 2)
                    raw, bias, w = fit_gram(unpack(g, dim), p, numeric, a, l1, int(it))
                    weights.append(raw.T.tolist())
                    scaled.append(w.T.tolist())
                    biases.append(bias.tolist())
                yield pdf[names].assign(weights=weights, bias=biases, scaled=scaled)

        fitted = spread(grams, names).mapInPandas(run, f"{kinds}weights array<array<double>>, bias array<double>, scaled array<array<double>>")
        # the cross products are of inputs less their medians; move that into the intercept
        def unshift(b: Column, w: Column) -> Column:
            moved = F.zip_with(F.slice(w, 1, numeric), F.col("medians"), lambda a, m: a * F.coalesce(m, F.lit(0.0)))
            return b - F.aggregate(moved, F.lit(0.0), lambda s, v: s + v) + F.col("target_level")

        table = fill.attach(fitted).withColumn("bias", F.zip_with("bias", "weights", unshift)).drop("target_level")
        return FittedElasticNet(stage(table, "elastic-net"), inputs, len(targets), self.scope)


@dataclass(frozen=True)
class FittedElasticNet(FittedForecaster):
    """``table``: one row per model (scope..., medians, modes, weights, bias, scaled).

    ``weights`` apply to imputed raw inputs: scaling of inputs and targets is folded in.
    """

    table: DataFrame
    inputs: Inputs
    horizon: int
    scope: tuple[str, ...] = ()

    def coefficients(self) -> DataFrame:
        """(scope..., horizon, feature, weight, scaled_weight); the bias is feature ``(intercept)``."""
        names = F.array(*[F.lit(n) for n in self.inputs.encoded])
        per = self.table.select(*self.scope, F.posexplode(F.arrays_zip("weights", "bias", "scaled")).alias("h", "m"))
        weights = per.select(*self.scope, (F.col("h") + 1).alias("horizon"), F.inline(F.arrays_zip(names.alias("feature"), F.col("m.weights").alias("weight"), F.col("m.scaled").alias("scaled_weight"))))
        bias = per.select(*self.scope, (F.col("h") + 1).alias("horizon"), F.lit("(intercept)").alias("feature"), F.col("m.bias").alias("weight"), F.lit(None).cast("double").alias("scaled_weight"))
        return weights.unionByName(bias)

    def attach(self, df: DataFrame) -> DataFrame:
        """Rows with the fill values, weights and bias of their model."""
        if self.scope:
            return join_models(df, self.table.select(*self.scope, *PARTS), self.scope)
        row = self.table.first()
        return df.withColumns({c: literal(row[c], kind) for c, kind in PARTS.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds pred_1..pred_H.  Weights are literals for one model, and joined by series otherwise."""
        names = prediction_names(self.horizon)
        joined = self.attach(df).withColumn("_x", F.array(*imputed(self.inputs)))
        dots = F.transform(
            F.arrays_zip("weights", "bias"),
            lambda m: m["bias"] + F.aggregate(F.zip_with(m["weights"], F.col("_x"), lambda w, x: w * x), F.lit(0.0), lambda a, v: a + v),
        )
        done = joined.withColumn("_p", dots)
        return done.withColumns({n: F.col("_p")[h] for h, n in enumerate(names)}).drop(*PARTS, "_x", "_p")

    def save(self, path: str) -> None:
        info = self.table.sparkSession.createDataFrame(
            [(list(self.inputs.numeric), list(self.inputs.categorical), self.horizon, list(self.scope))],
            "numeric array<string>, categorical array<string>, horizon int, scope array<string>",
        )
        self.table.write.mode("overwrite").parquet(f"{path}/models")
        info.coalesce(1).write.mode("overwrite").parquet(f"{path}/info")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedElasticNet:
        info = spark.read.parquet(f"{path}/info").first()
        inputs = Inputs.of(info["numeric"], info["categorical"])
        return FittedElasticNet(spark.read.parquet(f"{path}/models"), inputs, info["horizon"], tuple(info["scope"]))
