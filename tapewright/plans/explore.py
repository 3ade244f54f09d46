"""The tables behind the exploratory figures, from one price table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators.sampling import seeded_sample
from tapewright.operators.series import (
    KEYS, add_ema, add_log_return, add_moving_average, add_rolling_volatility,
)
from tapewright.operators.stats import autocorrelation, correlation, density, describe, histogram


def returns_known(price: DataFrame, keys=KEYS) -> DataFrame:
    return add_log_return(price, keys).where(F.col("log_return").isNotNull())


def explore(price: DataFrame, seed: int = 42, sample: int = 1000, keys=KEYS) -> dict[str, DataFrame]:
    """Lazy tables: prices, averages, volatility, distribution, autocorrelation, correlation, sample."""
    df = returns_known(price, keys)
    ohlc = ["open", "high", "low", "close"]
    return {
        "describe": describe(price, [*ohlc, "adj_close", "volume"], keys),
        "price_series": df.select(*keys, "date", "adj_close"),
        "correlation": correlation(df, [*ohlc, "volume"], keys),
        "moving_averages": add_ema(add_moving_average(df, keys=keys), keys=keys).select(*keys, "date", "adj_close", "sma_10", "ema_10"),
        "histogram": histogram(df, keys=keys),
        "density": density(df, keys=keys),
        "volatility": add_rolling_volatility(df, keys=keys).select(*keys, "date", "volatility"),
        "autocorrelation": autocorrelation(df, keys=keys),
        "ohlc_sample": seeded_sample(df, sample, seed, [*keys, "date"]).select(*keys, "date", *ohlc),
    }
