"""Imputation, scaling and one-hot encoding as statistics tables and column expressions.

Medians and modes are one table row per model (``scope`` keys, fold); means and deviations
are taken after imputation.  Statistics come from training rows only.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.operators.joins import join_models
from tapewright.operators.quantiles import exact_quantiles

# All levels of the calendar parts.
LEVELS: dict[str, tuple[int, ...]] = {"dow": (0, 1, 2, 3, 4, 5, 6), "quarter": (1, 2, 3, 4)}


@dataclass(frozen=True)
class Inputs:
    """Numeric and categorical model inputs and the order of the encoded columns."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    levels: tuple[tuple[str, tuple[int, ...]], ...] = ()

    @staticmethod
    def of(numeric: Sequence[str], categorical: Sequence[str] = (), levels: dict[str, Sequence[int]] | None = None) -> Inputs:
        table = {**LEVELS, **(levels or {})}
        return Inputs(tuple(numeric), tuple(categorical), tuple((c, tuple(table[c])) for c in categorical))

    @property
    def encoded(self) -> list[str]:
        """Names after encoding: numeric first, then one per level."""
        return [*self.numeric, *[f"{c}_{v}" for c, vs in self.levels for v in vs]]


def _mode(c: str) -> Column:
    return F.mode(F.col(c), True)


@dataclass(frozen=True)
class Fill:
    """Medians and modes: a table with one row per model, or plain values of a single model."""

    table: DataFrame | None = None
    scope: tuple[str, ...] = ()
    medians: tuple[float | None, ...] = ()
    modes: tuple[int | None, ...] = ()
    level: float = 0.0  # mean of all targets, in the table where there is one

    def columns(self) -> dict[str, Column]:
        """The values of a single model as literals."""
        return {"medians": literal(self.medians, "array<double>"), "modes": literal(self.modes, "array<int>"), "target_level": F.lit(self.level)}

    def attach(self, df: DataFrame) -> DataFrame:
        return join_models(df, self.table, self.scope) if self.scope else df.withColumns(self.columns())


def literal(values, kind: str) -> Column:
    """Nested lists of numbers as one folded literal (JSON keeps doubles exactly)."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def fill_values(df: DataFrame, inputs: Inputs, scope: Sequence[str] = (), targets: Sequence[str] = ()) -> Fill:
    """Median of every numeric and mode (lowest on a tie) of every categorical input.

    Per series the medians are grouped aggregates over a bounded series.  Without scope, one
    model for all rows, the bracketing algorithm of ``exact_quantiles`` keeps memory bounded.
    A column without any value gets no median and is left out of the model.  With ``targets``
    also their common mean.
    """
    means = F.array_compact(F.array(*[F.avg(F.col(t).cast("double")) for t in targets])) if targets else F.array().cast("array<double>")
    level = F.when(F.size(means) > 0, F.aggregate(means, F.lit(0.0), lambda a, x: a + x) / F.size(means)).otherwise(0.0).alias("target_level")
    num, cat = inputs.numeric, inputs.categorical
    if scope:
        known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in num]
        medians = F.array(*[F.percentile(x, F.lit(0.5)) for x in known])
        modes = F.array(*[_mode(c).cast("int") for c in cat]) if cat else F.array().cast("array<int>")
        return Fill(df.groupBy(*scope).agg(medians.cast("array<double>").alias("medians"), modes.alias("modes"), level), tuple(scope))
    total, level, *modes = df.agg(F.count(F.lit(1)), level, *[_mode(c).cast("int").alias(c) for c in cat]).first()
    found = exact_quantiles(df, num, [0.5], total=total) if num else {}
    return Fill(medians=tuple(found[c][0] for c in num), modes=tuple(modes), level=level)


def imputed(inputs: Inputs, shifted: bool = False) -> list[Column]:
    """Encoded input columns for rows that carry ``medians`` and ``modes``.

    Unknown levels encode as all zeros.  An input without a median counts as 0; NaN counts
    as missing.  ``shifted`` subtracts the medians, which keeps sums of products accurate for
    inputs whose level is large compared with their spread.
    """
    num = []
    for i, c in enumerate(inputs.numeric):
        median = F.coalesce(F.col("medians")[i], F.lit(0.0))
        value = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), median)
        num.append((value - median if shifted else value).alias(c))
    hot = [
        F.coalesce((F.coalesce(F.col(c).cast("int"), F.col("modes")[i]) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}")
        for i, (c, vs) in enumerate(inputs.levels)
        for v in vs
    ]
    return [*num, *hot]


def encode(df: DataFrame, inputs: Inputs, fill: Fill, keep: Sequence[str]) -> DataFrame:
    """keep columns + imputed numeric columns + one-hot columns (not scaled)."""
    return fill.attach(df).select(*keep, *imputed(inputs))


def scale_stats(encoded: DataFrame, inputs: Inputs, scope: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of the imputed numeric inputs (deviation 0 counts as 1)."""
    means = F.array(*[F.avg(c) for c in inputs.numeric]).alias("means")
    stds = F.array(*[F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)) for c in inputs.numeric]).alias("stds")
    return encoded.groupBy(*scope).agg(means, stds)


def standardise(encoded: DataFrame, inputs: Inputs, stats: DataFrame, keep: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Numeric inputs centred and scaled; one-hot columns unchanged."""
    if scope:
        joined = encoded.join(stats, list(scope))
    else:
        row = stats.first()
        joined = encoded.withColumns({c: literal(row[c], "array<double>") for c in ("means", "stds")})
    num = [((F.col(c) - F.col("means")[i]) / F.col("stds")[i]).alias(c) for i, c in enumerate(inputs.numeric)]
    return joined.select(*keep, *num, *inputs.encoded[len(num):])


def prep_stats(train: DataFrame, inputs: Inputs, scope: Sequence[str] = ()) -> DataFrame:
    """Long table (scope..., position, feature, median, mean, std); mode under ``median`` for categoricals."""
    fill = fill_values(train, inputs, scope)
    both = fill.attach(scale_stats(encode(train, inputs, fill, list(scope)), inputs, scope))
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col("medians")[i].alias("median"), F.col("means")[i].alias("mean"), F.col("stds")[i].alias("std"))
        for i, c in enumerate(inputs.numeric)
    ] + [
        F.struct(F.lit(len(inputs.numeric) + i).alias("position"), F.lit(c).alias("feature"), F.col("modes")[i].cast("double").alias("median"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"))
        for i, c in enumerate(inputs.categorical)
    ]
    return both.select(*scope, F.inline(F.array(*rows)))


def seen_levels(train: DataFrame, inputs: Inputs, scope: Sequence[str] = ()) -> DataFrame:
    """Levels that occur in training rows (scope..., feature, level)."""
    sets = train.groupBy(*scope).agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in inputs.categorical])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("array<int>").alias("levels")) for c in inputs.categorical])
    return sets.select(*scope, F.inline(rows)).select(*scope, "feature", F.explode("levels").alias("level"))


def target_scale(train: DataFrame, targets: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """(scope..., target, mean, std) with population deviation; 0 counts as 1."""
    rows = F.array(*[
        F.struct(F.lit(t).alias("target"), F.avg(t).alias("mean"), F.when(F.stddev_pop(t) == 0, 1.0).otherwise(F.stddev_pop(t)).alias("std"))
        for t in targets
    ])
    return train.groupBy(*scope).agg(rows.alias("_r")).select(*scope, F.inline("_r"))


def scale_target(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / std


def unscale_target(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean
