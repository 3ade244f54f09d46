"""Running figures along very long series, without a task that sees a whole series.

A scan works on chunks and hands what has gone before to the next one.  For sums that is a
total; for exponentially decayed sums it is a pair of weight and sum, and chunks combine by
multiplying weights.  Both are associative, so what chunks hand on is itself scanned, level
by level.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions.text import col
from tapewright.operators.series import KEYS
from tapewright.session import stage

FAN = 4096


def exclusive_sums(df: DataFrame, keys: Sequence[str], index: str, sums: Mapping[str, str], fan: int = FAN) -> DataFrame:
    """Adds, per series, the sums over all rows of smaller ``index``; sums: {new column: column}.

    ``df`` holds one row per series and index.  A task sees ``fan`` indexes of a series, or the
    totals of so many groups: two levels, 16 million indexes with the default.
    """
    tagged = df.withColumn("_group", F.floor(F.col(index) / fan))
    inside = W.partitionBy(*keys, "_group").orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy(*keys).orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys, "_group").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    before = totals.select(*keys, "_group", *[F.sum(f"_all_{n}").over(above).alias(f"_before_{n}") for n in sums])
    out = tagged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(before, [*keys, "_group"])
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums})
    return out.drop("_group", *[f"_before_{n}" for n in sums])


def decayed_sums(df: DataFrame, sums: Mapping[str, Column | str], ratio: float, keys=KEYS, pos: str = "pos", rows: int = 65_536) -> DataFrame:
    """Adds s(t) = x(t) + ratio * s(t - 1) along the gapless positions ``pos`` of each series.

    Within a chunk the scan is a running sum of x * ratio**-k (k: place in the chunk), whose
    weights stay below 1e100.  A chunk hands on its weight, ratio to the power of its length,
    and its sum; these are scanned in the same way until older chunks weigh nothing.
    """
    if not 0.0 < ratio < 1.0:
        raise ValueError("the ratio lies between 0 and 1")
    size = max(1, min(rows, math.floor(230.0 / -math.log(ratio))))
    weight = ratio**size
    place, chunk = F.col(pos) % size, F.floor(F.col(pos) / size)
    tagged = df.withColumns({"_k": place, "_chunk": chunk})
    x = {n: F.coalesce(col(c).cast("double"), F.lit(0.0)) for n, c in sums.items()}
    fade = lambda steps: F.pow(F.lit(ratio), steps)
    ends = tagged.groupBy(*keys, "_chunk").agg(*[F.sum(v * fade(size - 1 - F.col("_k"))).alias(f"_end_{n}") for n, v in x.items()])
    if weight > 1e-30:
        ends = stage(ends.withColumnRenamed("_chunk", "_pos"), "chunk-ends")
        ends = decayed_sums(ends, {f"_end_{n}": f"_end_{n}" for n in sums}, weight, keys, "_pos", rows).withColumnRenamed("_pos", "_chunk")
    before = ends.withColumn("_chunk", F.col("_chunk") + 1)
    inside = W.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    grow = F.pow(F.lit(1.0 / ratio), F.col("_k"))
    out = tagged.withColumns({f"_in_{n}": F.sum(v * grow).over(inside) for n, v in x.items()}).join(before, [*keys, "_chunk"], "left")
    out = out.withColumns({n: F.col(f"_in_{n}") * fade(F.col("_k")) + F.coalesce(f"_end_{n}", F.lit(0.0)) * fade(F.col("_k") + 1) for n in sums})
    return out.drop("_k", "_chunk", *[f"{p}{n}" for n in sums for p in ("_in_", "_end_")])


def add_long_ema(df: DataFrame, value: str, span: int, name: str = "ema", keys=KEYS, rows: int = 65_536) -> DataFrame:
    """Exponential average with adjusted weights along ``pos``, for any span; NULL counts as missing."""
    x = F.col(value).cast("double")
    summed = decayed_sums(df, {"_ema_sum": x, "_ema_weight": x.isNotNull().cast("double")}, 1.0 - 2.0 / (span + 1.0), keys, rows=rows)
    ema = F.when(F.col("_ema_weight") > 0, F.col("_ema_sum") / F.col("_ema_weight"))
    return summed.withColumn(name, ema).drop("_ema_sum", "_ema_weight")
