"""Data-quality guards.  A violation is a row with its reason, not an exception."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators.series import KEYS, add_successor

# Limits of a prediction request.
MAX_ROWS = 2000
MAX_SPAN_DAYS = 365 * 5


def span_and_cardinality(df: DataFrame, keys=KEYS, date: str = "date") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(date).alias("n_dates"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.datediff(F.max(date), F.min(date)).alias("span_days"),
    )


def price_violations(df: DataFrame, keys=KEYS, max_rows: int = MAX_ROWS, max_span: int = MAX_SPAN_DAYS) -> DataFrame:
    """(series, reason, observed) per broken limit."""
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.datediff(F.max("date"), F.min("date")).cast("long").alias("_span")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("_n") > max_rows, F.struct(F.lit("too_many_rows").alias("reason"), F.col("_n").alias("observed"))),
            F.when(F.col("_span") > max_span, F.struct(F.lit("span_too_long").alias("reason"), F.col("_span").alias("observed"))),
        )
    )
    return stats.select(*keys, F.inline(reasons))


def news_violations(df: DataFrame, keys=KEYS, max_rows: int = MAX_ROWS) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"))
    return stats.where(F.col("observed") > max_rows).select(*keys, F.lit("too_many_rows").alias("reason"), "observed")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def usable_rows(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Rows whose targets are all known."""
    return df.na.drop(subset=list(targets))


def with_successor(df: DataFrame, keys=KEYS) -> DataFrame:
    """Rows that have a following row in their series."""
    marked = add_successor(df, ["date"], keys, prefix="_next_")
    return marked.where(F.col("_next_date").isNotNull()).drop("_next_date")


def valid_forecasts(df: DataFrame, dates: str = "predicted_dates", prices: str = "predicted_price_path") -> DataFrame:
    return df.where((F.size(dates) > 0) & (F.size(dates) == F.size(prices)))
