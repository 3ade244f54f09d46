"""Look-back queries on landed price and article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions.text import iso_day, occurrences
from tapewright.operators.columns import require_columns
from tapewright.operators.guards import require_rows
from tapewright.operators.series import KEYS
from tapewright.schemas import ARTICLES, PRICE_COLUMNS

LOOKBACK_FACTOR = 2


def price_history(price: DataFrame, end_date: str, days: int = 90, symbol: str | None = None, check: bool = False) -> DataFrame:
    """Rows in [end - 2 * days, end) of one symbol, or of all.

    Plain comparisons on bare columns, so both bounds and the symbol reach the scan.
    """
    require_columns(price, PRICE_COLUMNS)
    end = F.lit(end_date).cast("date")
    rows = price.where((F.col("date") >= F.date_sub(end, days * LOOKBACK_FACTOR)) & (F.col("date") < end))
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    return require_rows(rows, "Price history") if check else rows


def explode_articles(payloads: DataFrame, body: str = "body", keep=KEYS) -> DataFrame:
    """JSON bodies {"articles": [...]} -> (keep..., published, date, headline); bad bodies give no rows."""
    article = F.explode(F.from_json(F.col(body), ARTICLES)["articles"])
    return payloads.select(*keep, article.alias("a")).select(
        *keep,
        F.col("a.publishedAt").alias("published"),
        F.to_date(iso_day("a.publishedAt")).alias("date"),
        F.col("a.title").alias("headline"),
    )


def relevance(text: str, query: str) -> Column:
    return occurrences(F.lower(F.col(text)), query.lower())


def news_history(articles: DataFrame, query: str, end_date: str, days: int = 7, limit: int = 100, keys=KEYS, lang: str | None = "en", tiebreak: str = "seq") -> DataFrame:
    """The ``limit`` most relevant articles per series in [end - days, end] that mention ``query``."""
    end = F.lit(end_date).cast("date")
    rows = articles.where(F.col("date").between(F.date_sub(end, days), end))
    if lang is not None:
        rows = rows.where(F.col("lang") == lang)
    found = rows.withColumn("relevance", relevance("headline", query)).where(F.col("relevance") > 0)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("relevance").desc(), tiebreak))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")
