"""Headlines for price dates that have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.text import fallback_headline
from tapewright.operators.joins import missing_news_dates
from tapewright.operators.series import KEYS


def enrich_news(price: DataFrame, news: DataFrame, keys=KEYS, generate: Callable[[Column, Column], Column] = fallback_headline) -> DataFrame:
    """Real headlines and one generated headline per missing date.

    ``generate(symbol, date)`` returns a text column: the template by default, or a pandas UDF
    that asks a model.
    """
    gaps = missing_news_dates(price, news, keys)
    generated = gaps.withColumn("headline", generate(F.col(keys[0]), F.col("date"))).withColumn("generated", F.lit(True))
    real = news.select(*keys, "date", "headline", F.lit(False).alias("generated"))
    return real.unionByName(generated)
