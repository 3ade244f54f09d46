"""Descriptive statistics behind the exploratory figures, as tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.operators.gram import gram_table, unpack
from tapewright.operators.long_series import add_long_position, with_halo
from tapewright.operators.prep import literal
from tapewright.operators.series import KEYS, series_window

#: Cells per bandwidth of the density.
CELLS = 8
# Hermite polynomials 0 to 7 as (power, coefficient).
HERMITE = (((0, 1.0),), ((1, 1.0),), ((2, 1.0), (0, -1.0)), ((3, 1.0), (1, -3.0)), ((4, 1.0), (2, -6.0), (0, 3.0)), ((5, 1.0), (3, -10.0), (1, 15.0)),
           ((6, 1.0), (4, -15.0), (2, 45.0), (0, -15.0)), ((7, 1.0), (5, -21.0), (3, 105.0), (1, -105.0)))
# Fixed value: two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def to_long(df: DataFrame, keep: Sequence[str], cols: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(list(keep), list(cols), name, value)


def describe(df: DataFrame, cols: Sequence[str], keys=KEYS) -> DataFrame:
    """count, mean, std, min, quartiles and max per series and column.

    Quartiles are exact; their buffers are bounded because a series is bounded.  For one
    column over all series use :func:`tapewright.operators.quantiles.exact_quantiles`.
    """
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        to_long(df, keys, cols)
        .groupBy(*keys, "column")
        .agg(
            F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), q.alias("_q"), F.max("value").alias("max"),
        )
        .select(*keys, "column", "count", "mean", "std", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max")
    )


def non_null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, type, non-null rows), from one aggregate."""
    types = dict(df.dtypes)
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count(c).alias(c) for c in cols])
    entries = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(c).alias("non_null")) for c in cols]
    return counts.select(F.inline(F.array(*entries)))


def correlation(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every column pair i < j over the rows where both are known; NULL where one is constant.

    One table of cross products of presence marks, values and squares gives the moments of all pairs over their own
    rows, for as many columns as one matrix holds (its side is three times their number).  Values are taken less the
    mean of their column, so that large levels do not hide small spreads.  NaN counts as missing; an infinite value
    makes the correlations of its column NaN.
    """
    names, count = list(cols), len(cols)
    value = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in names]
    means = df.groupBy(*keys).agg(F.array(*[F.avg(v) for v in value]).cast("array<double>").alias("_means"))
    if keys:
        known = df.select(*keys, *names).join(means, list(keys))
    else:
        row_means = means.first()["_means"]
        known = df.select(*names).withColumn("_means", literal(row_means, "array<double>"))
    shifted = [v - F.coalesce(F.col("_means")[i], F.lit(0.0)) for i, v in enumerate(value)]
    marks = [v.isNotNull().cast("double") for v in value]
    x = [F.coalesce(v, F.lit(0.0)) for v in shifted]
    grams = gram_table(known, list(keys), [*marks, *x, *[v * v for v in x]], [])
    grams = grams.join(means, list(keys)) if keys else grams.withColumn("_means", literal(row_means, "array<double>"))
    kinds = "".join(f"{c} {dict(df.dtypes)[c]}, " for c in keys)
    pairs = list(combinations(range(count), 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                full = unpack(row.gram, 1 + 3 * count)[1:, 1:]
                level = np.abs(np.array([0.0 if m is None else m for m in row.means], dtype=float))
                n = full[:count, :count]
                with np.errstate(all="ignore"):
                    first, second = full[count:2 * count, :count] / n, full[2 * count:, :count] / n  # of i over the rows of j
                    spread = second - first * first
                    spread[spread <= 1e-28 * (level[:, None] + np.abs(first)) ** 2] = 0.0
                    both = (full[count:2 * count, count:2 * count] / n - first * first.T) / np.sqrt(spread * spread.T)
                for i, j in pairs:
                    flat = n[i, j] < 2 or spread[i, j] == 0 or spread[j, i] == 0
                    found.append((*[getattr(row, c) for c in keys], names[i], names[j], None if flat else float(both[i, j])))
            yield pd.DataFrame(found, columns=[*keys, "a", "b", "corr"])

    return grams.select(*keys, "gram", F.col("_means").alias("means")).mapInPandas(run, f"{kinds}a string, b string, corr double")


def value_range(df: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """Count, ends and spread of a column per series; ends of a constant are moved apart by 0.5."""
    low, high = F.min(value), F.max(value)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.when(low == high, low - 0.5).otherwise(low).alias("low"),
        F.when(low == high, high + 0.5).otherwise(high).alias("high"),
        F.stddev_samp(value).alias("std"),
    ).where(F.col("n") > 0)


def histogram(df: DataFrame, value: str = "log_return", bins: int = 50, keys=KEYS, log_scale: bool = False) -> DataFrame:
    """Equal-width bins per series, empty ones included; the maximum falls in the last bin."""
    known = df.where(F.col(value).isNotNull())
    if log_scale:
        known = known.where(F.col(value) > 0).withColumn(value, F.log10(value))
    ends = value_range(known, value, keys)
    place = F.least(F.width_bucket(F.col(value), F.col("low"), F.col("high"), F.lit(bins)), F.lit(bins))
    counts = (
        known.select(*keys, value).join(ends, list(keys))
        .groupBy(*keys, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    )
    width = (F.col("high") - F.col("low")) / bins
    left, right = F.col("low") + width * (F.col("bin") - 1), F.col("low") + width * F.col("bin")
    if log_scale:
        left, right = F.pow(F.lit(10.0), left), F.pow(F.lit(10.0), right)
    return (
        ends.select(*keys, "low", "high", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
        .join(counts, [*keys, "bin"], "left")
        .select(*keys, "bin", left.alias("bin_left"), right.alias("bin_right"), F.coalesce("count", F.lit(0)).alias("count"))
    )


def density(df: DataFrame, value: str = "log_return", points: int = 200, bins: int = 50, keys=KEYS) -> DataFrame:
    """Gaussian kernel density on a grid from the least to the greatest value (Scott's bandwidth).

    Values are summed to moments per cell once, cells an eighth of the bandwidth wide; the kernels of a cell's values
    at a grid point are then a series in these moments.  With eight terms the error of a kernel is below
    105/8! * (1/16)^8 = 6.1e-13 of its peak, and kernels further than ten bandwidths away are below 2e-22.  What meets
    the grid are cells, whose number depends on the spread of the values and not on the number of rows.  ``scaled`` is
    the density in units of histogram counts.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    ends = value_range(known, "_x", keys).withColumn("_bw", F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    spread = ends.where(F.col("std") > 0).select(*keys, "n", "low", "high", "_bw", ((F.col("high") - F.col("low")) / (points - 1)).alias("_step"))
    cell = F.floor((F.col("_x") - F.col("low")) / F.col("_bw") * CELLS)
    middle = F.col("low") + (F.col("_cell") + 0.5) * F.col("_bw") / CELLS
    placed = known.join(spread, list(keys)).withColumn("_cell", cell).withColumn("_t", (F.col("_x") - middle) / F.col("_bw"))
    moments = [F.sum(F.pow("_t", F.lit(k))).alias(f"_m{k}") for k in range(len(HERMITE))]
    cells = placed.groupBy(*keys, "low", "_bw", "_step", "_cell").agg(*moments).withColumn("_at", middle)
    place = lambda x: ((x - F.col("low")) / F.col("_step")).cast("long")
    first = F.greatest(place(F.col("_at") - 10 * F.col("_bw")), F.lit(0))
    last = F.least(place(F.col("_at") + 10 * F.col("_bw")) + 1, F.lit(points - 1))
    met = cells.withColumn("point", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    met = met.withColumn("_u", (F.col("low") + F.col("_step") * F.col("point") - F.col("_at")) / F.col("_bw"))
    terms = [F.col(f"_m{k}") / math.factorial(k) * sum((c * F.pow("_u", F.lit(p)) for p, c in polynomial), F.lit(0.0)) for k, polynomial in enumerate(HERMITE)]
    sums = met.groupBy(*keys, "point").agg(F.sum(F.exp(-0.5 * F.col("_u") * F.col("_u")) * sum(terms[1:], terms[0])).alias("_sum"))
    grid = spread.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    peak = F.col("_bw") * F.sqrt(F.lit(2.0) * F.pi())
    at = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / F.lit(points - 1)
    return (
        grid.join(sums, [*keys, "point"], "left")
        .withColumn("density", F.greatest(F.coalesce("_sum", F.lit(0.0)), F.lit(0.0)) / F.col("n") / peak)
        .select(*keys, "point", at.alias("x"), "density", (F.col("density") * F.col("n") * (F.col("high") - F.col("low")) / bins).alias("scaled"))
    )


def autocorrelation(df: DataFrame, value: str = "log_return", lags: int = 30, keys=KEYS, order=("date",)) -> DataFrame:
    """Biased autocorrelation for lags 1..k and the half-width of Bartlett's 95 % band."""
    known = df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).alias("_x"))
    centred = known.withColumn("_d", F.col("_x") - F.avg("_x").over(W.partitionBy(*keys)))
    return _correlogram(_lag_products(centred, lags, series_window(keys, order)), lags, keys)


def long_autocorrelation(df: DataFrame, value: str, time: str, tiebreak: Sequence[str], lags: int = 30, keys=KEYS, rows: int = 65_536) -> DataFrame:
    """The same for series of any length: lag products within chunks, which see the last rows of the chunk before."""
    known = df.where(F.col(value).isNotNull()).select(*keys, time, *tiebreak, F.col(value).cast("double").alias("_x"))
    placed = add_long_position(known, time, tiebreak, keys)
    means = placed.groupBy(*keys).agg(F.avg("_x").alias("_mean"))
    centred = placed.join(means, list(keys)).select(*keys, "pos", (F.col("_x") - F.col("_mean")).alias("_d"))
    chunks = with_halo(centred, lags, 0, max(rows, lags))
    products = _lag_products(chunks, lags, W.partitionBy(*keys, "_chunk").orderBy("pos"))
    return _correlogram(products.where(F.col("_chunk") == F.col("_home")), lags, keys)


def _lag_products(centred: DataFrame, lags: int, w) -> DataFrame:
    return centred.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, lags + 1)})


def _correlogram(lagged: DataFrame, lags: int, keys: Sequence[str]) -> DataFrame:
    sums = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_s0"),
        *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(1, lags + 1)],
    )
    entries = [F.struct(F.lit(k).alias("lag"), F.try_divide(F.coalesce(F.col(f"_s{k}"), F.lit(0.0)), F.col("_s0")).alias("acf")) for k in range(1, lags + 1)]
    long = sums.select(*keys, "n", F.inline(F.array(*entries)))
    before = W.partitionBy(*keys).orderBy("lag").rowsBetween(W.unboundedPreceding, -1)
    spread = F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(before), F.lit(0.0))
    return long.withColumn("band", Z95 * F.sqrt((1.0 + 2.0 * spread) / F.col("n"))).drop("n")
