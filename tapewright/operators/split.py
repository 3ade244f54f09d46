"""Chronological split and expanding folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators.columns import target_columns
from tapewright.operators.series import KEYS, latest_first, series_window


def time_series_split(df: DataFrame, train: float = 0.8, val: float = 0.1, horizon: int = 30, keys=KEYS, order=("date",)) -> DataFrame:
    """Adds ``split`` (train, val, test; NULL where a target is unknown) and ``is_forecast``.

    The boundaries floor a double, as ``int(n * ratio)`` does.  The forecast set is the tail
    of all rows of a series.
    """
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in target_columns(df)])
    w = series_window(keys, order)
    out = df.withColumn("_usable", usable).withColumns(
        {
            "_rank": F.sum(F.col("_usable").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1,
            "_total": F.sum(F.col("_usable").cast("long")).over(W.partitionBy(*keys)),
            "_from_end": F.row_number().over(latest_first(keys, order)),
        }
    )
    train_end = F.floor(F.col("_total") * F.lit(train))
    val_end = F.floor(F.col("_total") * F.lit(train + val))
    label = (
        F.when(~F.col("_usable"), None)
        .when(F.col("_rank") < train_end, "train")
        .when(F.col("_rank") < val_end, "val")
        .otherwise("test")
    )
    return out.withColumns({"split": label, "is_forecast": F.col("_from_end") <= horizon}).drop(
        "_usable", "_rank", "_total", "_from_end"
    )


def expanding_folds(df: DataFrame, n_splits: int = 2, gap: int = 0, keys=KEYS, order=("date",)) -> DataFrame:
    """Rows copied into (fold, role): fold i tests the i-th of k+1 blocks and trains on what lies before.

    Blocks have n div (k+1) rows; the surplus is at the front.
    """
    placed = df.withColumns(
        {
            "_pos": F.row_number().over(series_window(keys, order)) - 1,
            "_n": F.count(F.lit(1)).over(W.partitionBy(*keys)),
        }
    )
    exploded = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    size = F.floor(F.col("_n") / (n_splits + 1))
    start = F.col("_n") - (n_splits - F.col("fold")) * size
    role = (
        F.when(F.col("_pos") < start - gap, "train")
        .when((F.col("_pos") >= start) & (F.col("_pos") < start + size), "val")
    )
    return exploded.withColumn("role", role).where(F.col("role").isNotNull()).drop("_pos", "_n")


TRAIN, VAL, OUT = "T", "V", "-"


def fold_states(df: DataFrame, n_splits: int = 2, gap: int = 0, keys=KEYS, order=("date",)) -> DataFrame:
    """Adds ``states``, a letter per fold: training, validation or neither.  The folds of ``expanding_folds``, each row once."""
    placed = df.withColumns({
        "_pos": F.row_number().over(series_window(keys, order)) - 1,
        "_n": F.count(F.lit(1)).over(W.partitionBy(*keys)),
    })
    size, pos = F.floor(F.col("_n") / (n_splits + 1)), F.col("_pos")
    starts = [F.col("_n") - (n_splits - fold) * size for fold in range(n_splits)]
    states = [F.when(pos < start - gap, TRAIN).when((pos >= start) & (pos < start + size), VAL).otherwise(OUT) for start in starts]
    return placed.withColumn("states", F.concat(*states)).drop("_pos", "_n")


def in_fold(fold: int, role: str):
    """Rows of ``fold_states`` that have this role in a fold."""
    return F.substring("states", fold + 1, 1) == role
