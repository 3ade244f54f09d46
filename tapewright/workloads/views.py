"""Panels over the driver's tables: bars from orders, headlines from documents, ticks from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The five series names, in the order in which documents are dealt to them.
SYMBOLS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per order priority.  One partial aggregation: what is shuffled are bars, not orders."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"))
        .agg(
            F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, key).alias("close"), F.avg(price).alias("adj_close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


def symbol_of(doc_id) -> F.Column:
    names = F.array(*[F.lit(s) for s in SYMBOLS])
    return F.get(names, F.pmod(doc_id, F.lit(len(SYMBOLS))).cast("int"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One headline per document: the whole text."""
    doc = F.col("doc_id")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (40 * F.pmod(F.floor(doc / 5), F.lit(60))).cast("int"))
    return table(spark, sf_dir, "documents").select(
        symbol_of(doc).alias("symbol"), day.alias("date"), doc.alias("seq"), F.col("text").alias("headline"), "lang"
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw event stream per type: series without a calendar bound."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), "value")
