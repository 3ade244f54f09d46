"""Stage tables, predictions, metrics and parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = (), csv: bool = False) -> str:
    """Parquet by default; CSV with header where a file has to leave Spark."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).option("escape", '"').csv(path) if csv else writer.parquet(path)
    return path


def write_predictions(df: DataFrame, path: str) -> str:
    """Long predictions (kind, symbol, date, horizon, y_true, y_pred), one folder per kind."""
    return write_stage(df, path, ["kind"])


def write_metrics(df: DataFrame, path: str) -> str:
    """A few rows: one CSV file with header."""
    return write_stage(df.coalesce(1), path, csv=True)


def params_table(spark: SparkSession, params: Mapping[str, Any]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in params.items()], "key string, value string")


def write_params(spark: SparkSession, params: Mapping[str, Any], path: str) -> str:
    return write_metrics(params_table(spark, params), path)
