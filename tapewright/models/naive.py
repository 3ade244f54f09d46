"""Baselines that every model is reported beside: no return at all, or the last return again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.models.base import FittedForecaster, Forecaster, prediction_names


@dataclass(frozen=True)
class FittedNaive(FittedForecaster):
    horizon: int
    factor: float = 0.0
    scope: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        value = F.coalesce(F.col("log_return"), F.lit(0.0)) * self.factor if self.factor else F.lit(0.0)
        return df.withColumns({n: value for n in prediction_names(self.horizon)})

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame([(self.horizon, self.factor)], "horizon int, factor double").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedNaive:
        row = spark.read.parquet(path).first()
        return FittedNaive(row["horizon"], row["factor"])


@dataclass(frozen=True)
class Naive(Forecaster):
    """``factor`` times the last return for every horizon; 0 is the zero-return baseline."""

    horizon: int = 30
    factor: float = 0.0
    name = "naive"

    def with_params(self, **params: Any) -> Naive:
        return replace(self, **{k: v for k, v in params.items() if k in ("horizon", "factor")})

    def fit(self, train: DataFrame, features: Sequence[str], targets: Sequence[str], val: DataFrame | None = None) -> FittedNaive:
        return FittedNaive(len(targets), self.factor)
