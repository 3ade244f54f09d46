"""What every forecaster offers, and experiments made of them."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame


class FittedForecaster(ABC):
    """A fitted model: adds one ``pred_h`` column per horizon."""

    horizon: int
    scope: tuple[str, ...]

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    @abstractmethod
    def save(self, path: str) -> None: ...

    @property
    def predictions(self) -> list[str]:
        return prediction_names(self.horizon)


class Forecaster(ABC):
    """An estimator for one or several horizons."""

    name = "base"

    @abstractmethod
    def fit(self, train: DataFrame, features: Sequence[str], targets: Sequence[str], val: DataFrame | None = None) -> FittedForecaster:
        """``val`` serves early stopping where the model has it, and is ignored otherwise."""

    @abstractmethod
    def with_params(self, **params: Any) -> Forecaster: ...

    @classmethod
    def search_space(cls) -> dict[str, Any]:
        return {}


@dataclass(frozen=True)
class Experiment:
    """``build(horizon, seed)`` makes the model; sentiment inputs can be left out."""

    name: str
    build: Callable[[int, int], Forecaster]
    include_sentiment: bool = True


def prediction_names(horizon: int) -> list[str]:
    return [f"pred_{h}" for h in range(1, horizon + 1)]
