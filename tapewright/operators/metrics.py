"""Error metrics as aggregates, metric tables and their comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.series import KEYS, add_difference

METRICS = ("mae", "mse", "rmse", "smape", "r2")
MAXIMISE = frozenset({"r2"})


def _r2(y: Column, p: Column) -> Column:
    """1 - SSE / SST; a constant truth gives 1 when met exactly and 0 otherwise."""
    err = y - p
    sse, sst = F.sum(err * err), F.var_pop(y) * F.count(y)
    return F.when(sst > 0, 1.0 - F.try_divide(sse, sst)).when(sse == 0, 1.0).otherwise(0.0)


# name -> aggregate over (truth, prediction); user metrics can be added here
REGISTRY: dict[str, Callable[[Column, Column], Column]] = {
    "mae": lambda y, p: F.avg(F.abs(y - p)),
    "mse": lambda y, p: F.avg((y - p) * (y - p)),
    "rmse": lambda y, p: F.sqrt(F.avg((y - p) * (y - p))),
    "smape": lambda y, p: F.avg(2.0 * F.abs(p - y) / (F.abs(y) + F.abs(p) + 1e-12)),
    "r2": _r2,
}


def is_maximise(name: str) -> bool:
    return name.lower() in MAXIMISE


def paired(df: DataFrame, keep: Sequence[str], truth: Sequence[str], prediction: Sequence[str]) -> DataFrame:
    """Wide truth and prediction columns -> long (keep..., horizon, y_true, y_pred)."""
    if len(truth) != len(prediction):
        raise ValueError(f"Shape mismatch: {len(truth)} truths, {len(prediction)} predictions")
    entries = [
        F.struct(F.lit(h).alias("horizon"), F.col(t).cast("double").alias("y_true"), F.col(p).cast("double").alias("y_pred"))
        for h, (t, p) in enumerate(zip(truth, prediction), 1)
    ]
    return df.select(*keep, F.inline(F.array(*entries)))


def score(pairs: DataFrame, by: Sequence[str] = (), names: Sequence[str] = METRICS) -> DataFrame:
    """Metrics pooled over rows and horizons, one row per group; one pass."""
    y, p = F.col("y_true"), F.col("y_pred")
    return pairs.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(*[REGISTRY[n](y, p).alias(n) for n in names])


def in_sample_scale(history: DataFrame, value: str, keys=KEYS, order=("date",)) -> DataFrame:
    """Mean absolute step of the in-sample series; NULL below two points."""
    steps = add_difference(history.where(F.col(value).isNotNull()), value, "_step", keys, order)
    scale = F.greatest(F.avg(F.abs("_step")), F.lit(1e-8))
    return steps.groupBy(*keys).agg(F.when(F.count("_step") > 0, scale).alias("scale"))


def mase(pairs: DataFrame, history: DataFrame, value: str, keys=KEYS, order=("date",)) -> DataFrame:
    """Mean absolute error in units of the in-sample step."""
    errors = score(pairs, keys, ["mae"])
    return errors.join(in_sample_scale(history, value, keys, order), list(keys)).select(
        *keys, "mae", "scale", (F.col("mae") / F.col("scale")).alias("mase")
    )


def fold_scores(scores: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Mean over folds; negated where larger is better, so that the least value wins."""
    sign = -1.0 if is_maximise(metric) else 1.0
    return scores.groupBy(*by).agg((sign * F.avg("score")).alias("value"))


def best_trial(trials: DataFrame, by: Sequence[str] = (), value: str = "value", trial: str = "trial") -> DataFrame:
    """Trial with the least value; the lower number on a tie."""
    return trials.groupBy(*by).agg(F.min(F.struct(value, trial)).alias("_best")).select(*by, f"_best.{trial}", f"_best.{value}")


def tag(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def compare(metrics: DataFrame, index: Sequence[str], column: str, values: Sequence[str], names: Sequence[str] = METRICS, digits: int = 6) -> DataFrame:
    """One row per index, one column per (metric, variant)."""
    pivoted = metrics.groupBy(*index).pivot(column, list(values)).agg(*[F.first(n, True).alias(n) for n in names])
    return pivoted.select(*index, *[F.round(f"{v}_{n}", digits).alias(f"{n}_{v}") for n in names for v in values])


def improvement(table: DataFrame, index: Sequence[str], names: Sequence[str] = METRICS, better: str = "with", base: str = "without", digits: int = 6) -> DataFrame:
    """Positive where the ``better`` variant helps."""
    def gain(n: str) -> Column:
        a, b = (better, base) if is_maximise(n) else (base, better)
        return F.round(F.col(f"{n}_{a}") - F.col(f"{n}_{b}"), digits).alias(f"{n}_impr")

    return table.select(*index, *[gain(n) for n in names])
