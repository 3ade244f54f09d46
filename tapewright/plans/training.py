"""Experiments: split, select, tune, fit, predict, score, persist."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.models.base import Experiment, FittedForecaster, prediction_names
from tapewright.models.elastic_net import ElasticNet
from tapewright.models.naive import FittedNaive
from tapewright.operators.columns import feature_columns, target_columns
from tapewright.operators.metrics import METRICS, paired, score
from tapewright.operators.sampling import last_rows
from tapewright.operators.series import KEYS
from tapewright.operators.split import time_series_split
from tapewright.plans.tuning import Tuning, tune, tune_elastic_net
from tapewright.session import stage, stage_path
from tapewright.sinks.tables import params_table, write_metrics, write_predictions, write_stage


@dataclass(frozen=True)
class Result:
    """What an experiment leaves behind; tables are read from its folder."""

    kind: str
    horizon: int
    include_sentiment: bool
    features: list[str]
    model: FittedForecaster
    tuning: Tuning | None
    params: dict[str, Any]
    metrics: DataFrame
    predictions: DataFrame
    last_path: DataFrame
    paths: dict[str, str]


def predict_long(model: FittedForecaster, rows: DataFrame, targets: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., horizon, y_true, y_pred)."""
    return paired(model.transform(rows), keep, targets, prediction_names(len(targets)))


def evaluate(model: FittedForecaster, rows: DataFrame, targets: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Metrics pooled over rows and horizons, per group if asked."""
    return score(predict_long(model, rows, targets, by), by)


def prepare(df: DataFrame, horizon: int, keys=KEYS) -> DataFrame:
    """Feature table with its chronological split, written once for all experiments."""
    if len(target_columns(df)) != horizon:
        raise ValueError(f"{len(target_columns(df))} targets in the table, horizon {horizon} asked for")
    return stage(time_series_split(df, horizon=horizon, keys=keys), "features")


def run(prepared: DataFrame, exp: Experiment, horizon: int = 30, seed: int = 42, trials: int = 30, out: str | None = None, folds: int = 2, metric: str = "rmse", keys=KEYS) -> Result:
    """One experiment on a prepared table.

    The final model is fitted on training rows; validation rows only stop tree growth early.
    """
    out = out or stage_path(prepared.sparkSession, f"run-{exp.name}")
    targets = target_columns(prepared)
    features = feature_columns(prepared, keys, exp.include_sentiment)
    part = {s: prepared.where(F.col("split") == s) for s in ("train", "val", "test")}
    paths = {"X_test": write_stage(part["test"].select(*keys, "date", *features), f"{out}/X_test")}

    base, tuning, params, per_series = exp.build(horizon, seed), None, {}, None
    if trials and base.search_space():
        tuner = tune_elastic_net if isinstance(base, ElasticNet) else tune
        tuning = tuner(part["train"], features, targets, base, trials, folds, 0, metric, keys)
        if tuning.scope:
            per_series = tuning.best_table()
            paths["params"] = write_stage(per_series, f"{out}/params")
        else:
            params = {**tuning.best_params(), "random_state": seed}
            paths["params"] = write_metrics(params_table(prepared.sparkSession, params), f"{out}/params")
            base = base.with_params(**params)
        paths["trials"] = write_stage(tuning.trials, f"{out}/trials")
    if per_series is not None:
        model = base.fit(part["train"], features, targets, params=per_series)
    else:
        model = base.fit(part["train"], features, targets, part["val"])
    model.save(f"{out}/model")
    paths["model"] = f"{out}/model"

    long = predict_long(model, part["test"], targets, [*keys, "date"]).withColumn("kind", F.lit(exp.name))
    paths["predictions"] = write_predictions(long, f"{out}/predictions")
    predictions = prepared.sparkSession.read.parquet(paths["predictions"])
    summary = score(predictions, ["kind"]).select(F.col("kind").alias("name"), *METRICS)
    paths["metrics"] = write_metrics(summary, f"{out}/metrics")
    last = last_rows(part["test"], 1, keys)
    last_path = predict_long(model, last, targets, [*keys, "date"])
    return Result(exp.name, horizon, exp.include_sentiment, features, model, tuning, params, summary, predictions, last_path, paths)


def run_experiments(df: DataFrame, experiments: Sequence[Experiment], horizon: int = 30, seed: int = 42, trials: int = 30, out: str | None = None, keys=KEYS) -> list[Result]:
    """All experiments on one prepared table."""
    prepared = prepare(df, horizon, keys)
    return [run(prepared, e, horizon, seed, trials, f"{out}/{e.name}" if out else None, keys=keys) for e in experiments]


def with_baseline(metrics: DataFrame, prepared: DataFrame) -> DataFrame:
    """Metric rows plus one of the zero-return forecast on the same test rows."""
    targets = target_columns(prepared)
    zero = evaluate(FittedNaive(len(targets)), prepared.where("split = 'test'"), targets)
    return metrics.unionByName(zero.select(F.lit("zero_return").alias("name"), *METRICS))
