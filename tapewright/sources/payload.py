"""Nested prediction requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.calendar import parse_day
from tapewright.operators.columns import require_columns
from tapewright.schemas import PRICE_COLUMNS, REQUEST


def read_requests(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Requests, one JSON object per line; ``whole_files`` for one object per file."""
    return spark.read.schema(REQUEST).option("multiLine", whole_files).json(path)


def parse_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    return bodies.select(F.from_json(F.col(body), REQUEST).alias("r")).select("r.*")


def request_prices(requests: DataFrame, keep=("symbol",)) -> DataFrame:
    """One row per price entry; ``seq`` is the place in the request."""
    rows = requests.select(*keep, F.posexplode("price").alias("seq", "p")).select(*keep, F.col("seq").cast("long"), "p.*")
    return require_columns(rows, PRICE_COLUMNS).withColumn("date", parse_day("date"))


def request_news(requests: DataFrame, keep=("symbol",)) -> DataFrame:
    """One row per headline; a request without news gives no rows."""
    rows = requests.select(*keep, F.posexplode("news").alias("seq", "n")).select(*keep, F.col("seq").cast("long"), "n.*")
    return rows.withColumn("date", parse_day("date"))
