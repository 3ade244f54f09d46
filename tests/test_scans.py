"""Scans over series that no task sees as a whole."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.operators import long_series, scans, series, stats


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal(n).cumsum() + 100


@pytest.mark.parametrize("span, rows", [(10, 65_536), (10, 7), (5000, 64), (5000, 3), (1, 16)])
def test_decayed_averages(spark, span, rows):
    """Short and long memory; long memory needs several levels of carried chunks."""
    if span == 1:
        with pytest.raises(ValueError, match="ratio"):
            scans.add_long_ema(spark.range(3).withColumnRenamed("id", "pos").withColumn("symbol", F.lit("a")), "pos", span)
        return
    frames = []
    for s, n in (("hot", 2000), ("short", 3), ("one", 1)):
        x = pd.Series(walk(n))
        x[n // 2::37] = np.nan
        frames.append(pd.DataFrame({"symbol": s, "pos": range(n), "x": x, "want": x.ewm(span=span, adjust=True).mean()}))
    data = pd.concat(frames)
    rows_ = [(a, int(b), None if np.isnan(c) else float(c)) for a, b, c in data[["symbol", "pos", "x"]].itertuples(index=False)]
    df = spark.createDataFrame(rows_, "symbol string, pos long, x double").repartition(7)
    got = scans.add_long_ema(df, "x", span, "ema", rows=rows).orderBy("symbol", "pos").toPandas()
    np.testing.assert_allclose(got.ema.astype(float), data.sort_values(["symbol", "pos"]).want, rtol=1e-9)


def test_decayed_average_equals_the_daily_one(spark, linear_price):
    df = series.add_position(linear_price(700))
    both = scans.add_long_ema(series.add_ema(df), "adj_close", 10, "long").select("ema_10", "long").toPandas()
    np.testing.assert_allclose(both.long, both.ema_10, rtol=1e-12)


@pytest.mark.parametrize("fan", [3, 4096])
def test_exclusive_sums_in_two_levels(spark, fan):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("i"), F.col("id").alias("x"))
    for r in scans.exclusive_sums(df, ["k"], "i", {"before": "x"}, fan).collect():
        assert r.before == sum(2 * j + r.k for j in range(r.i))


def test_a_flooded_second_is_cut(spark, monkeypatch):
    """3 million rows of one second, and equal tie-breaks among them: no range above the bound."""
    n, bound = 3_000_000, 200_000
    flood = spark.range(n).select(F.lit("hot").alias("symbol"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.floor(F.col("id") / 50).alias("seq"), F.col("id"))
    ranged = long_series._ranged(flood, "ts", ["seq"], ["symbol"], bound)
    sizes = [r["count"] for r in ranged.groupBy(F.shiftrightunsigned("_at", 33).alias("p")).count().collect()]
    assert sum(sizes) == n and max(sizes) <= bound
    placed = long_series.add_long_position(flood, "ts", ["seq"], bound=bound)
    off = placed.where(F.floor(F.col("pos") / 50) != F.col("seq")).count()
    assert off == 0 and placed.agg(F.count_distinct("pos")).first()[0] == n


def test_a_series_of_very_many_chunks(spark):
    """10^5 chunks of a series: sums are carried over two levels."""
    df = spark.range(400_000).select(F.lit("hot").alias("symbol"), F.col("id").alias("pos"), F.lit(1.0).alias("x"))
    got = long_series.running_sum(df, "x", "total", rows=4)
    assert got.where(F.col("total") != F.col("pos") + 1).count() == 0


@pytest.mark.parametrize("rows", [40, 1000])
def test_autocorrelation_by_chunks(spark, rows):
    values = walk(1500)
    data = [("hot", i, float(v)) for i, v in enumerate(values)] + [("s", 5, 1.0), ("s", 6, None), ("s", 7, 4.0), ("s", 8, 2.0)]
    df = spark.createDataFrame(data, "symbol string, ts long, v double").repartition(5)
    whole = stats.autocorrelation(df, "v", 30, order=("ts",)).orderBy("symbol", "lag").toPandas()
    cut = stats.long_autocorrelation(df, "v", "ts", [], 30, rows=rows).orderBy("symbol", "lag").toPandas()
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-10)
