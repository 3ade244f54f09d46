"""Feature table and inference rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions.arrays import zero_block
from tapewright.operators.columns import drop_targets, require_columns
from tapewright.operators.sampling import last_rows
from tapewright.operators.series import (
    KEYS, add_log_return, calendar_exprs, lag_exprs, series_window, target_exprs,
)
from tapewright.schemas import SENTIMENT_COLUMNS


def create_features(df: DataFrame, horizon: int = 1, back: int = 7, keys=KEYS, order: Sequence[str] = ("date",), date: str = "date", price: str = "adj_close") -> DataFrame:
    """Log return, lags, calendar parts and H targets; the warm-up rows are dropped.

    The first kept row has a NULL ``lag_{back}``: it would read the return of row 0.
    """
    require_columns(df, [price])
    w = series_window(keys, order)
    out = add_log_return(df, keys, order, price).withColumns({
        **target_exprs(horizon, w), **lag_exprs(back, w), **calendar_exprs(date), "_place": F.row_number().over(w),
    })
    return out.where(F.col("_place") > back).drop("_place")


def zero_sentiment(price: DataFrame, dims: int = 17) -> DataFrame:
    """Sentiment block when there is no news at all: zeros, not NULLs."""
    names = [*SENTIMENT_COLUMNS, *[f"emb_{i}" for i in range(dims)]]
    return price.select("*", *zero_block(names))


def merged_panel(price: DataFrame, daily: DataFrame | None, keys=KEYS, dims: int = 17) -> DataFrame:
    """Prices with daily sentiment; ``daily=None`` stands for a run without any news.

    A series without a single headline gets zeros, a series with news on some days keeps
    NULLs on the others (they are imputed later).
    """
    if daily is None:
        return zero_sentiment(price, dims)
    on, names = [*keys, "date"], [c for c in daily.columns if c not in (*keys, "date", "headline_count")]
    # a full join keeps headlines of days without a price until it is known that their series has news;
    # the window needs the exchange that the feature windows use anyway
    both = price.withColumn("_price", F.lit(True)).join(
        daily.drop("headline_count").withColumn("_news", F.lit(True)), on, "full"
    )
    whole = series_window(keys).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    covered = both.withColumn("_covered", F.max("_news").over(whole)).where(F.col("_price"))
    return covered.withColumns(
        {c: F.when(F.col("_covered").isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in names}
    ).drop("_price", "_news", "_covered")


def inference_rows(price: DataFrame, daily: DataFrame | None = None, back: int = 7, dims: int = 17, keys=KEYS) -> DataFrame:
    """The newest feature row of every series, without targets; series shorter than the warm-up give none.

    Features look back ``back`` returns, so that many prices and two more are all that is joined and windowed.
    """
    recent = last_rows(price, back + 2, keys)
    features = create_features(merged_panel(recent, daily, keys, dims), 0, back, keys)
    return last_rows(drop_targets(features), 1, keys)
