import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.operators import features, guards, joins, sampling, series, split
from tapewright.operators.long_series import add_long_position, over_chunks, running_sum

SCHEMA = "symbol string, date date, adj_close double"


def daily(spark, values, symbol="A", start=dt.date(2020, 1, 1)):
    return spark.createDataFrame([(symbol, start + dt.timedelta(i), v) for i, v in enumerate(values)], SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "date").collect()]


@pytest.fixture
def noisy(spark):
    rng = random.Random(1)
    a = [100.0 * math.exp(rng.gauss(0, 0.02)) for _ in range(400)]
    b = [50.0 * math.exp(rng.gauss(0, 0.02)) for _ in range(37)]
    return a, b, daily(spark, a).unionByName(daily(spark, b, "B"))


def test_features_by_hand(spark):
    prices = [100.0 + i * i for i in range(14)]
    got = features.create_features(daily(spark, prices), 3).orderBy("date").collect()
    ret = [None] + [math.log(prices[i] / prices[i - 1]) for i in range(1, 14)]
    assert len(got) == 7
    assert got[0]["lag_7"] is None and got[0]["lag_6"] == pytest.approx(ret[1])
    assert got[2]["target_3"] == pytest.approx(ret[12])
    assert got[-1]["target_1"] is None and got[-1]["lag_1"] == pytest.approx(ret[12])
    assert (got[0]["quarter"], got[0]["dow"]) == (1, dt.date(2020, 1, 8).weekday())


def test_single_horizon_has_one_target(spark):
    assert "target" in features.create_features(daily(spark, [1.0] * 10)).columns


def test_short_series_give_no_features(spark):
    assert features.create_features(daily(spark, [1.0] * 7), 2).count() == 0
    assert features.create_features(daily(spark, []), 2).count() == 0
    with pytest.raises(ValueError):
        features.create_features(daily(spark, [1.0]).drop("adj_close"))


def test_zero_price_gives_null_return(spark):
    assert column(series.add_log_return(daily(spark, [0.0, 1.0, 2.0])), "log_return")[:2] == [None, None]


def test_rolling_values_match_pandas(spark, noisy):
    a, b, df = noisy
    df = series.add_log_return(df)
    df = series.add_rolling_volatility(series.add_ema(series.add_moving_average(df)))
    got = df.orderBy("symbol", "date").toPandas()
    for symbol, values in (("A", a), ("B", b)):
        mine = got[got.symbol == symbol]
        s = pd.Series(values)
        np.testing.assert_allclose(mine.sma_10, s.rolling(10).mean(), rtol=1e-12)
        np.testing.assert_allclose(mine.ema_10, s.ewm(span=10).mean(), rtol=1e-13)
        np.testing.assert_allclose(mine.volatility, np.log(s / s.shift(1)).rolling(20).std(), rtol=1e-9)


def test_ema_skips_missing_values(spark):
    values = [1.0, None, 3.0, None, None, 4.0, 8.0]
    got = column(series.add_ema(daily(spark, values)), "ema_10")
    np.testing.assert_allclose(got, pd.Series(values).ewm(span=10).mean(), rtol=1e-13)


def test_price_path_and_difference(spark):
    df = daily(spark, [10.0, 11.0, 12.0]).withColumn("r", F.lit(math.log(2.0)))
    assert column(series.add_price_path(df.withColumn("p0", F.lit(1.0)), "p0", "r", order=("date",)), "price") == pytest.approx([2.0, 4.0, 8.0])
    assert column(series.add_difference(df, "adj_close"), "diff") == [None, 1.0, 1.0]


def test_results_do_not_depend_on_partitioning(spark, noisy):
    df = noisy[2]
    one = features.create_features(df, 5).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    many = features.create_features(df.repartition(13), 5).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(one, many)


@pytest.mark.parametrize("seed, rows", [(86_400, 16), (3_600, 64), (7, 1000)])
def test_chunked_windows_equal_whole_windows(spark, seed, rows):
    """A hot series with gaps and equal times, cut into small chunks."""
    rng = random.Random(seed)
    base = dt.datetime(2024, 3, 30)
    data = []
    for i in range(1500):
        symbol = "hot" if rng.random() < 0.8 else f"s{rng.randrange(4)}"
        jump = rng.choice([0, 0, 30, 3000, 400000])
        base += dt.timedelta(seconds=jump)
        data.append((symbol, base, i, rng.random() + 0.1))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "symbol string, ts timestamp_ntz, seq long, value double")

    def steps(part, keys, order):
        part = series.add_log_return(part, keys, order, "value")
        part = series.add_targets(series.add_lags(part, 7, keys, order), 5, keys, order)
        return series.add_moving_average(part, "value", 10, "sma_10", keys, order)

    whole = steps(df, ["symbol"], ["ts", "seq"]).orderBy("seq").toPandas()
    cut = over_chunks(df, steps, "ts", ["seq"], back=9, ahead=5, rows=rows).orderBy("seq").toPandas()
    pd.testing.assert_frame_equal(whole, cut[whole.columns], rtol=1e-12)

    placed = add_long_position(df, "ts", ["seq"], bound=20)
    want = pd.DataFrame(data, columns=["symbol", "ts", "seq", "value"]).sort_values(["symbol", "ts", "seq"])
    want["pos"] = want.groupby("symbol").cumcount()
    want["total"] = want.groupby("symbol")["value"].cumsum()
    got = running_sum(placed, "value", "total", rows=32).orderBy("seq").toPandas()
    want = want.sort_values("seq").reset_index(drop=True)
    assert got.pos.tolist() == want.pos.tolist()
    np.testing.assert_allclose(got.total, want.total, rtol=1e-9)


def test_split_adds_up_and_keeps_order(spark):
    df = features.create_features(daily(spark, [float(i + 1) for i in range(100)]), 10)
    got = split.time_series_split(df, 0.7, 0.2, 10).orderBy("date").collect()
    labels = [r["split"] for r in got]
    usable = len(got) - 10
    assert labels.count("train") == int(usable * 0.7)
    assert labels.count("train") + labels.count("val") == int(usable * (0.7 + 0.2))
    assert labels == sorted(labels[:usable], key=["train", "val", "test"].index) + [None] * 10
    assert [r["is_forecast"] for r in got] == [False] * usable + [True] * 10


def test_split_floors_a_double(spark):
    # 0.7 + 0.2 is 0.8999999999999999, so 30 usable rows end at 26
    df = features.create_features(daily(spark, [float(i + 1) for i in range(38)]), 1)
    labels = [r["split"] for r in split.time_series_split(df, 0.7, 0.2, 1).collect()]
    assert labels.count("test") == 4


def test_folds_expand(spark):
    df = daily(spark, [1.0] * 11)
    got = split.expanding_folds(df, 3, 1).orderBy("fold", "date").collect()
    want = {}
    for r in got:
        want.setdefault((r["fold"], r["role"]), []).append((r["date"] - dt.date(2020, 1, 1)).days)
    assert want == {
        (0, "train"): [0, 1, 2, 3], (0, "val"): [5, 6],
        (1, "train"): [0, 1, 2, 3, 4, 5], (1, "val"): [7, 8],
        (2, "train"): [0, 1, 2, 3, 4, 5, 6, 7], (2, "val"): [9, 10],
    }


def test_join_keeps_every_price_row(spark):
    price = daily(spark, [1.0, 2.0, 3.0])
    news = spark.createDataFrame([("A", dt.date(2020, 1, 2), "x"), ("A", dt.date(2020, 1, 2), "y"), ("A", dt.date(2021, 1, 1), "off")], "symbol string, date date, headline string")
    got = [(r["date"].day, r["headline"]) for r in joins.merge_price_news(price, news, validate=True).orderBy("date", "headline").collect()]
    assert got == [(1, None), (2, "x"), (2, "y"), (3, None)]
    hot = joins.merge_price_news(price, news, many=True, rows_per_task=1)
    assert hot.columns == joins.merge_price_news(price, news).columns
    assert [(r["date"].day, r["headline"]) for r in hot.orderBy("date", "headline").collect()] == got


def test_repeated_price_dates_are_refused(spark):
    price = daily(spark, [1.0, 2.0]).unionByName(daily(spark, [3.0]))
    with pytest.raises(ValueError, match="not unique"):
        joins.merge_price_news(price, price.select("symbol", "date"), validate=True)


def test_last_arrival_wins(spark):
    df = spark.createDataFrame([("A", 1, 5, "old"), ("A", 1, 9, "new"), ("A", 2, 7, "only")], "symbol string, date int, seq long, v string")
    assert sorted(r["v"] for r in sampling.dedupe_last(df).collect()) == ["new", "only"]


def test_news_caps(spark):
    rows = [("A", day, day * 100 + i) for day in range(70) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, date int, seq long")
    got = sorted(r["seq"] for r in sampling.trim_news(df).collect())
    want = [day * 100 + i for day in range(70) for i in range(20)][-1000:]
    assert got == want


def test_sample_is_seeded(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = sampling.seeded_sample(df, 20, 1, ["k"]).collect()
    assert a == sampling.seeded_sample(df.repartition(9), 20, 1, ["k"]).collect()
    assert a != sampling.seeded_sample(df, 20, 2, ["k"]).collect()
    assert sampling.seeded_sample(df, 1000, 1, ["k"]).count() == 500


def test_guards(spark):
    long_span = spark.createDataFrame([("A", dt.date(2000, 1, 1)), ("A", dt.date(2005, 1, 1)), ("B", dt.date(2000, 1, 1))], "symbol string, date date")
    assert [(r[0], r[1], r[2]) for r in guards.price_violations(long_span).collect()] == [("A", "span_too_long", 1827)]
    many = spark.range(2001).select(F.lit("A").alias("symbol"), F.current_date().alias("date"))
    assert [r["reason"] for r in guards.news_violations(many).collect()] == ["too_many_rows"]
    with pytest.raises(ValueError):
        guards.require_rows(long_span.limit(0), "prices")


def test_inference_row_without_news_is_zero(linear_price):
    row = features.inference_rows(linear_price(40)).collect()
    assert len(row) == 1
    assert row[0]["pos"] == 0.0 and row[0]["emb_16"] == 0.0 and "target_1" not in row[0].asDict()


def test_news_free_series_get_zeros_and_others_nulls(spark):
    price = daily(spark, [1.0, 2.0]).unionByName(daily(spark, [1.0, 2.0], "B"))
    sent = spark.createDataFrame([("A", dt.date(2020, 1, 4), 0.5, 3)], "symbol string, date date, pos double, headline_count long")
    got = [(r["symbol"], r["pos"]) for r in features.merged_panel(price, sent).orderBy("symbol", "date").collect()]
    assert got == [("A", None), ("A", None), ("B", 0.0), ("B", 0.0)]
