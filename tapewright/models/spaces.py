"""Search spaces as data, and seeded draws from them."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float
    log: bool = False

    def draw(self, rng: np.random.Generator) -> float:
        if self.log:
            return float(math.exp(rng.uniform(math.log(self.low), math.log(self.high))))
        return float(rng.uniform(self.low, self.high))


@dataclass(frozen=True)
class Steps:
    low: int
    high: int
    step: int = 1

    def draw(self, rng: np.random.Generator) -> int:
        return int(rng.choice(np.arange(self.low, self.high + 1, self.step)))


@dataclass(frozen=True)
class Choice:
    options: tuple

    def draw(self, rng: np.random.Generator) -> Any:
        return self.options[int(rng.integers(len(self.options)))]


@dataclass(frozen=True)
class When:
    """Drawn only if ``test(params so far)`` holds, else ``otherwise``."""

    test: Callable[[dict], bool]
    then: Any
    otherwise: Any

    def draw(self, rng: np.random.Generator, params: dict) -> Any:
        chosen = self.then if self.test(params) else self.otherwise
        return chosen.draw(rng) if hasattr(chosen, "draw") else chosen


def sample(space: dict[str, Any], trials: int, seed: int) -> list[dict[str, Any]]:
    """``trials`` parameter sets; the same seed gives the same sets."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        params: dict[str, Any] = {}
        for name, rule in space.items():
            if isinstance(rule, When):
                params[name] = rule.draw(rng, params)
            else:
                params[name] = rule.draw(rng) if hasattr(rule, "draw") else rule
        out.append(params)
    return out
