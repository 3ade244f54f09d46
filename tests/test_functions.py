import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapewright.functions import calendar as cal
from tapewright.functions import text as tx
from tapewright.functions.arrays import column_stack, ravel
from tapewright.functions.numeric import as_double, cumulative, log_ratio, path_from_returns, softmax
from tapewright.operators import columns


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("raw", ["  a b\t\n", " x　", " é \x1c", "plain", " \r\n ", ""])
def test_strip_is_python_strip(spark, raw):
    assert one(spark, tx.strip("t"), t=raw) == raw.strip()


def test_occurrences_do_not_overlap(spark):
    assert one(spark, tx.occurrences(F.col("t"), "aa"), t="aaaa.aa") == 3.0


def test_symbol_pattern(spark):
    for name, ok in (("AAPL", True), ("^DJI", True), ("BRK.B", True), ("AAP L", False), ("", False), ("A\n", False)):
        assert one(spark, tx.symbol_valid("s"), s=name) is ok


def test_fallback_headline(spark):
    df = spark.createDataFrame([("AAPL", dt.date(2024, 8, 2))], "symbol string, date date")
    assert df.select(tx.fallback_headline("symbol", "date")).first()[0] == "AAPL news on 2024-08-02 (auto-generated)"


def test_business_days_skip_weekends(spark):
    for day in (dt.date(2024, 5, 31), dt.date(2024, 6, 1), dt.date(2024, 6, 2)):
        got = spark.createDataFrame([(day,)], "d date").select(cal.business_days("d", 6)).first()[0]
        want, at = [], day
        while len(want) < 6:
            at += dt.timedelta(1)
            if at.weekday() < 5:
                want.append(at)
        assert got == want


def test_bad_dates(spark):
    assert one(spark, cal.coerce_day("d"), d="2024-13-01") is None
    with pytest.raises(Exception):
        one(spark, cal.parse_day("d"), d="nonsense")


def test_monday_is_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 10, 6),)], "d date")
    assert [tuple(r) for r in df.select(cal.day_of_week("d"), cal.quarter("d")).collect()] == [(0, 1), (6, 4)]


def test_log_ratio_needs_positive_prices(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 2.0), (2.0, 1.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(log_ratio("a", "b")).collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(0.6931471805599453) and got[3] is None


def test_softmax_survives_large_logits(spark):
    df = spark.createDataFrame([(1000.0, 1000.0, -1000.0)], "a double, b double, c double")
    a, b, c = df.select(*softmax(*[F.col(x) for x in "abc"])).first()
    assert (a, b, c) == (0.5, 0.5, 0.0)


def test_numbers_or_null(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(as_double("s")).collect()] == [1.5, None, None, None]


def test_cumulative_and_path(spark):
    df = spark.createDataFrame([([0.1, -0.2, 0.3],), ([],)], "v array<double>")
    sums = [r[0] for r in df.select(cumulative(F.col("v"))).collect()]
    assert sums[0] == pytest.approx([0.1, -0.1, 0.2]) and sums[1] == []
    path = df.select(path_from_returns(F.lit(100.0), F.col("v"))).first()[0]
    assert path == pytest.approx([110.51709180756477, 90.48374180359595, 122.14027581601698])


def test_ravel_and_stack_are_inverse(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 4.0, None, 6.0)], "k string, x double, y double, z double")
    back = column_stack(ravel(df, ["k"], ["x", "y", "z"]), ["k"]).orderBy("k").collect()
    assert [r["values"] for r in back] == [[1.0, 2.0, 3.0], [4.0, None, 6.0]]


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Open", "Adj Close ", " Volume"])
    assert columns.rename_columns(df).columns == ["open", "adj_close", "volume"]


def test_required_columns_are_listed_sorted(spark):
    with pytest.raises(ValueError, match=r"\['close', 'open'\]"):
        columns.require_columns(spark.createDataFrame([(1,)], ["date"]), ["open", "date", "close"])


def test_column_roles(spark):
    names = ["symbol", "date", "open", "adj_close", "pos", "emb_0", "headline_count", "log_return", "lag_1", "dow", "quarter", "target_1", "split"]
    df = spark.createDataFrame([tuple([1] * len(names))], names)
    assert columns.feature_columns(df) == ["pos", "emb_0", "headline_count", "log_return", "lag_1", "dow", "quarter"]
    assert columns.feature_columns(df, include_sentiment=False) == ["log_return", "lag_1", "dow", "quarter"]
    assert columns.split_types(["log_return", "quarter", "dow", "target_1", "date"]) == (["log_return"], ["dow", "quarter"])
    with pytest.raises(ValueError):
        columns.split_types(["date", "target"])
    with pytest.raises(ValueError):
        columns.target_columns(df.select("date"))
