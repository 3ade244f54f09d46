"""Cross products of expanding folds from one pass over the rows.

A row takes part in several folds, but it has one state in each of them: training, validation
or neither.  Rows of a series fall into a few segments of equal states (blocks, and the rows
that a gap sets apart), so cross products per segment, added up per fold and role, give those
of every fold; no row is copied, and ten folds cost what two do.

Folds differ in what they impute.  The segments therefore hold the known values, the marks of
missing ones and the one-hot levels apart; the medians and modes of a fold enter as a linear
map of these columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators.gram import gram_table, unpack
from tapewright.operators.prep import Fill, Inputs, fill_values
from tapewright.operators.series import KEYS
from tapewright.operators.split import TRAIN, VAL, fold_states, in_fold


def fold_grams(rows: DataFrame, inputs: Inputs, targets: Sequence[str], scope: Sequence[str], folds: int, gap: int = 0, keys=KEYS) -> DataFrame:
    """(scope..., fold, train array<double>, val array<double>): packed cross products of [1, inputs, targets] per fold.

    Inputs are imputed by the training rows of the fold and less their medians, targets less a level per model.  ``rows``
    are read twice: for medians and modes of all folds, and for the cross products.
    """
    scope = list(scope)
    placed = fold_states(rows.na.drop(subset=list(targets)), folds, gap, keys)
    fills = _fold_fills(placed, inputs, scope, folds)
    level = _levels(placed, inputs, scope, targets)
    known = level.attach(placed)
    p, encoded = len(inputs.numeric), len(inputs.encoded) - len(inputs.numeric)

    value = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in inputs.numeric]
    shifted = [F.coalesce(v - F.coalesce(F.col("medians")[i], F.lit(0.0)), F.lit(0.0)) for i, v in enumerate(value)]
    gone = [v.isNull().cast("double") for v in value]
    hot = [F.coalesce((F.col(c).cast("int") == v).cast("double"), F.lit(0.0)) for c, vs in inputs.levels for v in vs]
    blank = [F.col(c).cast("int").isNull().cast("double") for c in inputs.categorical]
    y = [F.col(t).cast("double") - F.coalesce("target_level", F.lit(0.0)) for t in targets]
    segments = gram_table(known, [*scope, "states"], [*shifted, *gone, *hot, *blank], y)
    listed = segments.groupBy(*scope).agg(F.collect_list(F.struct("states", "gram")).alias("segments"))
    full = fills.attach(level.attach(listed).withColumn("shift", F.col("medians")).drop("medians", "modes", "target_level"))
    kinds = "".join(f"{c} {dict(placed.dtypes)[c]}, " for c in scope)
    levels = [(i, v) for i, (_, vs) in enumerate(inputs.levels) for v in vs]
    wide, cats, count = 1 + 2 * p + encoded + len(inputs.categorical) + len(targets), len(inputs.categorical), len(targets)

    def mapped(shift, medians, modes) -> np.ndarray:
        """Columns of a fold as combinations of those of the segments."""
        out = np.zeros((wide, 1 + p + encoded + count))
        out[0, 0] = 1.0
        for j in range(p):
            move = _number(shift[j]) - _number(medians[j])
            out[1 + j, 1 + j], out[0, 1 + j], out[1 + p + j, 1 + j] = 1.0, move, -move
        for k, (i, v) in enumerate(levels):
            out[1 + 2 * p + k, 1 + p + k] = 1.0
            out[1 + 2 * p + encoded + i, 1 + p + k] = float(modes[i] == v)
        out[wide - count:, 1 + p + encoded:] = np.eye(count)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                parts = [(s["states"], unpack(s["gram"], wide)) for s in row.segments]
                for f in range(folds):
                    columns = mapped(row.shift, row.medians[f * p:(f + 1) * p], row.modes[f * cats:(f + 1) * cats])
                    tri = np.triu_indices(columns.shape[1])
                    sums = [columns.T @ sum((g for s, g in parts if s[f] == role), np.zeros((wide, wide))) @ columns for role in (TRAIN, VAL)]
                    found.append((*[getattr(row, c) for c in scope], f, *[s[tri].tolist() for s in sums]))
            yield pd.DataFrame(found, columns=[*scope, "fold", "train", "val"])

    return full.select(*scope, "segments", "shift", "medians", "modes").mapInPandas(run, f"{kinds}fold int, train array<double>, val array<double>")


def _number(x) -> float:
    return 0.0 if x is None or x != x else float(x)


def _fold_fills(placed: DataFrame, inputs: Inputs, scope: Sequence[str], folds: int) -> Fill:
    """Medians and modes of the training rows of all folds, fold after fold in one list."""
    name = lambda c, f: f"{c}__{f}"
    every = [name(c, f) for f in range(folds) for c in inputs.numeric], [name(c, f) for f in range(folds) for c in inputs.categorical]
    levels = {name(c, f): vs for c, vs in inputs.levels for f in range(folds)}
    taken = placed.select(*scope, *[F.when(in_fold(f, TRAIN), F.col(c)).alias(name(c, f)) for f in range(folds) for c in (*inputs.numeric, *inputs.categorical)])
    return fill_values(taken, Inputs.of(*every, levels), scope)


def _levels(placed: DataFrame, inputs: Inputs, scope: Sequence[str], targets: Sequence[str]) -> Fill:
    """Means of the inputs and of all targets per model: constants that keep sums of squares small."""
    means = F.array(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))) for c in inputs.numeric]).cast("array<double>")
    known = F.array_compact(F.array(*[F.avg(F.col(t).cast("double")) for t in targets]))
    level = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)).otherwise(0.0)
    table = placed.groupBy(*scope).agg(means.alias("medians"), F.array().cast("array<int>").alias("modes"), level.alias("target_level"))
    if scope:
        return Fill(table, tuple(scope))
    row = table.first()
    return Fill(medians=tuple(row["medians"]), modes=(), level=row["target_level"])
