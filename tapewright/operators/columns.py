"""Column selection by name and prefix, and schema checks.  No job is started here."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapewright.schemas import OHLCV, SENTIMENT_COLUMNS

CATEGORICAL = ("dow", "quarter")


def normalise_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def rename_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_header(c) for c in df.columns])


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def is_target(name: str) -> bool:
    return name == "target" or name.startswith("target_")


def is_sentiment(name: str) -> bool:
    return name in SENTIMENT_COLUMNS or name in ("headline", "headline_count", "title") or name.startswith("emb_")


def target_columns(df: DataFrame) -> list[str]:
    found = [c for c in df.columns if is_target(c)]
    if not found:
        raise ValueError("No target columns: build the features first")
    return found


def feature_columns(df: DataFrame, keys: Sequence[str] = ("symbol",), include_sentiment: bool = True) -> list[str]:
    """Everything but keys, date, raw prices and targets; optionally without sentiment."""
    skip = {*keys, "date", "split", "is_forecast", *OHLCV}
    cols = [c for c in df.columns if c not in skip and not is_target(c)]
    return cols if include_sentiment else [c for c in cols if not is_sentiment(c)]


def split_types(cols: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) model inputs."""
    cat = [c for c in CATEGORICAL if c in cols]
    num = [c for c in cols if c not in cat and c != "date" and not is_target(c)]
    if not num and not cat:
        raise ValueError("No feature columns: only dates and targets are present")
    return num, cat


def drop_targets(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if is_target(c)])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def narrow(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Single precision at the model edge."""
    return df.withColumns({c: df[c].cast("float") for c in cols})
