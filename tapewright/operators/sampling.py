"""Latest rows, per-group caps, previews and seeded samples.

``row_number() <= k`` is planned with a group limit below the exchange, so at most k rows
per group and task are shuffled however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators.series import KEYS


def keep_first(df: DataFrame, group: Sequence[str], order: Sequence, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def last_rows(df: DataFrame, k: int = 1, keys=KEYS, order=("date",)) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc() for c in order], k)


def dedupe_last(df: DataFrame, keys=("symbol", "date"), arrival: str = "seq") -> DataFrame:
    """One row per key: the one that arrived last."""
    return keep_first(df, keys, [F.col(arrival).desc()], 1)


def trim_news(df: DataFrame, per_day: int | None = 20, total: int | None = 1000, keys=KEYS, arrival: str = "seq") -> DataFrame:
    """First ``per_day`` headlines of each date, then the last ``total`` of each series; None leaves a cut out."""
    if per_day is not None:
        df = keep_first(df, [*keys, "date"], [F.col(arrival)], per_day)
    return df if total is None else last_rows(df, total, keys, ("date", arrival))


def history_window(df: DataFrame, rows: int = 200, keys=KEYS, order=("date",)) -> DataFrame:
    """The ``rows`` rows up to and including the anchor, where ``df`` ends at the anchor."""
    return last_rows(df, rows, keys, order)


def seeded_sample(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """n rows without replacement, the same ones under any partitioning.

    Rows are ranked by a hash of seed and key; the ordered limit keeps n rows per task.
    """
    tag = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.withColumn("_tag", tag).orderBy("_tag", *key).limit(n).drop("_tag")


def head_rows(df: DataFrame, order: Sequence, n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)

