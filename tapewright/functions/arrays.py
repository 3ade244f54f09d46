"""Array expressions: embeddings, row-major flattening and its inverse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions.text import col


def truncate_dims(emb: Column | str, dims: int) -> Column:
    return F.slice(col(emb), 1, dims)


def flatten_dims(emb: Column | str, dims: int, prefix: str = "emb_") -> list[Column]:
    """One column per dimension, the form in which a feature matrix wants them."""
    return [col(emb)[i].cast("double").alias(f"{prefix}{i}") for i in range(dims)]


def zero_block(names: Sequence[str]) -> list[Column]:
    return [F.lit(0.0).alias(n) for n in names]


def ravel(df: DataFrame, keep: Sequence[str], cols: Sequence[str], step: str = "step", value: str = "value") -> DataFrame:
    """n x H columns -> long rows (keep..., step 1..H, value)."""
    pairs = F.array(*[F.struct(F.lit(i + 1).alias(step), col(c).cast("double").alias(value)) for i, c in enumerate(cols)])
    return df.select(*keep, F.inline(pairs))


def column_stack(df: DataFrame, keep: Sequence[str], step: str = "step", value: str = "value", out: str = "values") -> DataFrame:
    """Long rows -> one array per key, ordered by step (H entries, so bounded)."""
    ordered = F.sort_array(F.collect_list(F.struct(step, value)))
    return df.groupBy(*keep).agg(F.transform(ordered, lambda s: s[value]).alias(out))
