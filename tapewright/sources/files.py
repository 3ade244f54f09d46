"""Price, news, metric and stage files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.functions.calendar import coerce_day, format_day, parse_day
from tapewright.functions.text import strip
from tapewright.operators.columns import normalise_header, rename_columns
from tapewright.operators.metrics import METRICS


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, lines_in_cells: bool = False) -> DataFrame:
    """CSV with header; every column is text unless a schema is given (no inference pass).

    ``lines_in_cells`` is for quoted line breaks: a file is then read by one task.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", lines_in_cells)
    return (reader.schema(schema) if schema else reader).csv(path)


def load_price(spark: SparkSession, path: str, text: Sequence[str] = ("symbol",)) -> DataFrame:
    """Price CSV: header normalised, ``date`` parsed strictly, the rest as doubles; NaN becomes NULL.

    Order is a property of windows and outputs here, so nothing is sorted.
    """
    raw = rename_columns(spark.read.option("header", True).csv(path))
    missing = F.lit(None).cast("double")
    numbers = {c: F.nanvl(F.col(c).cast("double"), missing) for c in raw.columns if c != "date" and c not in text}
    return raw.withColumns({"date": parse_day("date"), **numbers})


def melt_news(wide: DataFrame, keep: Sequence[str] = ("date",)) -> DataFrame:
    """Columns Top1..TopN -> one row per headline; NULL cells go, texts are stripped.

    Keeps ``rank`` out, as only date and headline are news.
    """
    df = rename_columns(wide)
    top = [c for c in df.columns if c.startswith("top")]
    keep = [normalise_header(k) for k in keep]
    long = df.unpivot(keep, top, "rank", "headline").na.drop()
    return long.withColumn("headline", strip(F.col("headline").cast("string"))).drop("rank")


def load_news(spark: SparkSession, path: str, keep: Sequence[str] = ("date",), lines_in_cells: bool = False) -> DataFrame:
    return melt_news(read_csv(spark, path, lines_in_cells=lines_in_cells), keep).withColumn("date", parse_day("date"))


def coerce_dates(df: DataFrame, date: str = "date") -> DataFrame:
    """``date`` as ISO text, NULL where it cannot be read; unchanged without such a column."""
    return df.withColumn(date, format_day(coerce_day(date))) if date in df.columns else df


def load_csv(spark: SparkSession, path: str, date: str = "date") -> DataFrame:
    return coerce_dates(read_csv(spark, path), date)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_metrics(spark: SparkSession, paths: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """Metric CSVs of several experiments as one table."""
    schema = ", ".join(["name string", *[f"{n} double" for n in names]])
    return read_csv(spark, list(paths), schema)
