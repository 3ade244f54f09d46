"""Joins of prices, news and forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.operators.series import KEYS
from tapewright.session import stage

#: Rows of one key that a task may get; more frequent keys are dealt over several tasks.
ROWS_PER_TASK = 1_000_000
#: Frequent keys up to which their list is sent to all tasks; beyond it the list is joined like any other table.
BROADCAST_KEYS = 500_000


def duplicate_dates(price: DataFrame, keys=KEYS) -> DataFrame:
    """(series, date) pairs that occur more than once."""
    return price.groupBy(*keys, "date").count().where(F.col("count") > 1)


def check_unique_dates(price: DataFrame, keys=KEYS) -> DataFrame:
    """Raise when a price date repeats.  One aggregate over the key columns, eager."""
    bad = duplicate_dates(price, keys).limit(5).collect()
    if bad:
        raise ValueError(f"Price dates are not unique: {[tuple(r) for r in bad]}")
    return price


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys with ``_n``, their rows."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))


def frequent_keys(counts: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Of :func:`key_counts`, keys with more rows than a task may get, and ``_salts``, the tasks that their rows need."""
    return counts.where(F.col("_n") > rows_per_task).select(*on, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts"))


def spread_join(big: DataFrame, unique: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK, counts: DataFrame | None = None) -> DataFrame:
    """Left join on keys that are unique on the right and may be very frequent on the left.

    A key with more than ``rows_per_task`` rows is dealt over as many tasks as its count asks
    for: its left rows are salted by the row's own content, its single right row is copied
    once per salt.  All such keys are dealt; their list is counted before it is broadcast, and
    a longer one is joined by key, where adaptive execution splits large partitions.  ``counts``
    are the left side's :func:`key_counts` where they are at hand.
    """
    on = list(on)
    frequent = stage(frequent_keys(key_counts(big, on) if counts is None else counts, on, rows_per_task), "frequent")
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    others = [c for c in big.columns if c not in on]
    salts = F.coalesce("_salts", F.lit(1))
    place = F.pmod(F.xxhash64(*others), salts).cast("int") if others else F.lit(0)
    left = big.join(frequent, on, "left").withColumn("_salt", place).drop("_salts")
    right = unique.join(frequent, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"], "left").drop("_salt")


def join_models(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row with the columns of its series' model: NULL where there is none; NULL keys are a series too."""
    renamed = table.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(renamed, match, "left").drop(*[f"_of_{k}" for k in keys])


def merge_price_news(price: DataFrame, news: DataFrame, keys=KEYS, validate: bool = False, many: bool = False, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Every price row with the news of its date, if any; one-to-many.

    ``validate`` checks the one side first.  Skip it where prices come from an aggregation by
    (series, date) or from ``dedupe_last``: they are unique by construction.

    ``many`` is for raw headlines, where one date may hold a large share of all rows: matches
    come from a join with hot dates spread over tasks, and price dates without news are added.
    Daily sentiment has one row per date and needs no such care.
    """
    if validate:
        check_unique_dates(price, keys)
    on = [*keys, "date"]
    if not many:
        return price.join(news, on, "left")
    counts = stage(key_counts(news, on), "news-days")
    found = spread_join(news, price.withColumn("_price", F.lit(True)), on, rows_per_task, counts).where(F.col("_price")).drop("_price")
    bare = price.join(counts, on, "left_anti")
    columns = [*price.columns, *[c for c in news.columns if c not in on]]
    return found.select(*columns).unionByName(bare, allowMissingColumns=True)


def missing_news_dates(price: DataFrame, news: DataFrame, keys=KEYS) -> DataFrame:
    """Distinct price dates without any news."""
    on = [*keys, "date"]
    return price.select(*on).distinct().join(news.select(*on).distinct(), on, "left_anti")
