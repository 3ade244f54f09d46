"""Row-frame operators over series.

``keys`` name the series, ``order`` the time column.  A series of daily rows is bounded by
the calendar: a date occurs once per series, so a century is 36,525 rows and one window
partition always fits a task.  Raw tables, where one key may hold a third of all rows, are
reduced to such series by partial aggregation first; series that are not bounded by a
calendar (ticks) go through :mod:`tapewright.operators.long_series`, which feeds these same
operators with bounded chunks.

All expressions over one series share one window specification, so Spark plans one
exchange and one sort for them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions.calendar import day_of_week, quarter
from tapewright.functions.numeric import log_ratio
from tapewright.functions.text import col

KEYS = ("symbol",)


def series_window(keys: Sequence[str] = KEYS, order: Sequence[str] = ("date",)) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def latest_first(keys: Sequence[str] = KEYS, order: Sequence[str] = ("date",)) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])


def add_log_return(df: DataFrame, keys=KEYS, order=("date",), price: str = "adj_close") -> DataFrame:
    w = series_window(keys, order)
    return df.withColumn("log_return", log_ratio(price, F.lag(price).over(w)))


def lag_exprs(back: int, w: WindowSpec) -> dict[str, Column]:
    return {f"lag_{k}": F.lag("log_return", k).over(w) for k in range(1, back + 1)}


def add_lags(df: DataFrame, back: int = 7, keys=KEYS, order=("date",)) -> DataFrame:
    return df.withColumns(lag_exprs(back, series_window(keys, order)))


def target_names(horizon: int) -> list[str]:
    return [f"target_{h}" for h in range(1, horizon + 1)] if horizon > 1 else ["target"]


def target_exprs(horizon: int, w: WindowSpec) -> dict[str, Column]:
    return {name: F.lead("log_return", h).over(w) for h, name in enumerate(target_names(horizon), 1)}


def add_targets(df: DataFrame, horizon: int = 1, keys=KEYS, order=("date",)) -> DataFrame:
    return df.withColumns(target_exprs(horizon, series_window(keys, order)))


def calendar_exprs(date: str = "date") -> dict[str, Column]:
    return {"quarter": quarter(date), "dow": day_of_week(date)}


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(calendar_exprs(date))


def add_position(df: DataFrame, keys=KEYS, order=("date",), name: str = "pos") -> DataFrame:
    """0-based position in the series."""
    return df.withColumn(name, (F.row_number().over(series_window(keys, order)) - 1).cast("long"))


def drop_warmup(df: DataFrame, back: int = 7, keys=KEYS, order=("date",)) -> DataFrame:
    """The first ``back`` rows of every series go."""
    return add_position(df, keys, order, "_pos").where(F.col("_pos") >= back).drop("_pos")


def full_frame(value: Column | str, agg, rows: int, w: WindowSpec) -> Column:
    """``agg`` over the last ``rows`` rows, NULL unless the frame holds that many values."""
    frame = w.rowsBetween(1 - rows, 0)
    x = col(value)
    return F.when(F.count(x).over(frame) == rows, agg(x).over(frame))


def add_moving_average(df: DataFrame, value: str = "adj_close", rows: int = 10, name: str = "sma_10", keys=KEYS, order=("date",)) -> DataFrame:
    return df.withColumn(name, full_frame(value, F.avg, rows, series_window(keys, order)))


def add_rolling_volatility(df: DataFrame, value: str = "log_return", rows: int = 20, name: str = "volatility", keys=KEYS, order=("date",)) -> DataFrame:
    return df.withColumn(name, full_frame(value, F.stddev_samp, rows, series_window(keys, order)))


def add_ema(df: DataFrame, value: str = "adj_close", span: int = 10, name: str = "ema_10", keys=KEYS, order=("date",)) -> DataFrame:
    """Exponential average with adjusted weights, in constant work per row.

    Within a block of 2L rows the weighted sum is a running sum of ``x * r**-k`` (k = place
    in the block), which a window adds up incrementally.  Two block grids, shifted by L, give
    every row at least L rows of history in one of them; L is chosen so that older weights
    lie below double precision.  The window partitions are (series, block), hence small even
    for a very long series.
    """
    ratio = 1.0 - 2.0 / (span + 1.0)
    half = math.ceil(math.log(1e-20) / math.log(ratio))
    x = col(value).cast("double")
    out = add_position(df, keys, order, "_pos")
    sums = {}
    for tag, shift in (("a", 0), ("b", half)):
        place = (F.col("_pos") + shift) % (2 * half)
        block = F.floor((F.col("_pos") + shift) / (2 * half))
        out = out.withColumns({f"_block_{tag}": block, f"_place_{tag}": place})
        w = W.partitionBy(*keys, f"_block_{tag}").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        weight = F.pow(F.lit(1.0 / ratio), F.col(f"_place_{tag}"))
        num = F.sum(F.coalesce(x, F.lit(0.0)) * weight).over(w)
        den = F.sum(F.when(x.isNotNull(), weight).otherwise(0.0)).over(w)
        sums[tag] = F.when(den > 0, num / den)
    picked = F.when(F.col("_place_a") >= half, sums["a"]).otherwise(sums["b"])
    return out.withColumn(name, picked).drop("_pos", "_block_a", "_place_a", "_block_b", "_place_b")


def add_sentiment_trend(df: DataFrame, value: str = "pos_minus_neg", rows: int = 7, band: float = 0.05, keys=KEYS, order=("date",)) -> DataFrame:
    """Smoothed daily sentiment and its place relative to a neutral band."""
    smooth = add_moving_average(df, value, rows, "smoothed", keys, order)
    label = (
        F.when(F.col("smoothed") > band, "above")
        .when(F.col("smoothed") < -band, "below")
        .when(F.col("smoothed").isNotNull(), "inside")
    )
    return smooth.withColumn("band", label)


def add_difference(df: DataFrame, value: str, name: str = "diff", keys=KEYS, order=("date",)) -> DataFrame:
    return df.withColumn(name, col(value) - F.lag(value).over(series_window(keys, order)))


def add_price_path(df: DataFrame, start: str, returns: str, name: str = "price", keys=KEYS, order=("step",)) -> DataFrame:
    """start * exp(running sum of log returns)."""
    w = series_window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, col(start) * F.exp(F.sum(returns).over(w)))


def add_successor(df: DataFrame, cols: Sequence[str], keys=KEYS, order=("date",), prefix: str = "next_") -> DataFrame:
    """Values of the following row; NULL at the end of a series."""
    w = series_window(keys, order)
    return df.withColumns({f"{prefix}{c}": F.lead(c).over(w) for c in cols})
