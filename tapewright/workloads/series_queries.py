"""Queries on daily bars and ticks: windows, statistics, calendar, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import calendar as cal
from tapewright.functions.arrays import column_stack, ravel
from tapewright.functions.numeric import as_double, cumulative, safe_log
from tapewright.functions.text import symbol_valid
from tapewright.operators import columns, features, guards, joins, sampling, series, split, stats
from tapewright.operators.long_series import add_long_position, over_chunks, running_sum
from tapewright.operators.scans import add_long_ema
from tapewright.plans.explore import explore, returns_known
from tapewright.workloads.registry import H5, H30, LAGS, query
from tapewright.workloads.views import bars, table, ticks

OHLC = ["open", "high", "low", "close"]
PRICES = [*OHLC, "adj_close", "volume"]
LAG_COLS = [f"lag_{k}" for k in LAGS]
T30 = [f"target_{h}" for h in H30]
T5 = [f"target_{h}" for h in H5]
KD = ("symbol", "date")


def split5(spark, d):
    return split.time_series_split(features.create_features(bars(spark, d), 5), horizon=5)


@query("daily_bars", "SELECT * FROM v_price", PRICES)
def daily_bars(spark, d):
    return bars(spark, d)


@query("log_return", "SELECT symbol, date, log_return FROM v_returns", ["log_return"])
def log_return(spark, d):
    return series.add_log_return(bars(spark, d)).select(*KD, "log_return")


@query("returns_not_null", "SELECT symbol, date, adj_close, log_return FROM v_known", ["adj_close", "log_return"])
def returns_not_null(spark, d):
    return returns_known(bars(spark, d)).select(*KD, "adj_close", "log_return")


@query("lags", f"SELECT symbol, date, {', '.join(LAG_COLS)} FROM v_features5", LAG_COLS)
def lags(spark, d):
    return features.create_features(bars(spark, d), 5).select(*KD, *LAG_COLS)


@query("targets", f"SELECT symbol, date, {', '.join(T30)} FROM v_features30", T30)
def targets(spark, d):
    return features.create_features(bars(spark, d), 30).select(*KD, *T30)


@query("single_target", """SELECT symbol, date, lead(log_return) OVER (PARTITION BY symbol ORDER BY date) AS target FROM v_returns""", ["target"])
def single_target(spark, d):
    return series.add_targets(series.add_log_return(bars(spark, d)), 1).select(*KD, "target")


@query("feature_table", "SELECT * FROM v_features30", [*PRICES, "log_return", *T30, *LAG_COLS])
def feature_table(spark, d):
    return features.create_features(bars(spark, d), 30)


@query("drop_warmup", """SELECT symbol, date, adj_close FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM v_price) WHERE rn > 7""", ["adj_close"])
def drop_warmup(spark, d):
    return series.drop_warmup(bars(spark, d)).select(*KD, "adj_close")


@query("usable_rows", f"SELECT symbol, date, log_return FROM v_features30 WHERE {' AND '.join(f'{t} IS NOT NULL' for t in T30)}", ["log_return"])
def usable_rows(spark, d):
    return guards.usable_rows(features.create_features(bars(spark, d), 30), T30).select(*KD, "log_return")


@query("positional_index", "SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos FROM v_price")
def positional_index(spark, d):
    return series.add_position(bars(spark, d)).select(*KD, "pos")


@query("sma10", """SELECT symbol, date, CASE WHEN count(adj_close) OVER w = 10 THEN avg(adj_close) OVER w END AS sma_10
FROM v_price WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)""", ["sma_10"])
def sma10(spark, d):
    return series.add_moving_average(bars(spark, d)).select(*KD, "sma_10")


@query("ema10", """SELECT a.symbol, a.date,
  sum(b.adj_close * pow(CAST(9 AS DOUBLE) / 11, a.pos - b.pos)) / sum(pow(CAST(9 AS DOUBLE) / 11, a.pos - b.pos)) AS ema_10
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM v_price) a
JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM v_price) b
  ON a.symbol = b.symbol AND b.pos <= a.pos AND b.pos >= a.pos - 300
GROUP BY a.symbol, a.date""", ["ema_10"], digits=4)
def ema10(spark, d):
    return series.add_ema(bars(spark, d)).select(*KD, "ema_10")


@query("rolling_vol20", """SELECT symbol, date, CASE WHEN count(log_return) OVER w = 20 THEN stddev_samp(log_return) OVER w END AS volatility
FROM v_returns WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""", ["volatility"])
def rolling_vol20(spark, d):
    return series.add_rolling_volatility(series.add_log_return(bars(spark, d))).select(*KD, "volatility")


@query("first_difference", "SELECT symbol, date, adj_close - lag(adj_close) OVER (PARTITION BY symbol ORDER BY date) AS diff FROM v_price", ["diff"])
def first_difference(spark, d):
    return series.add_difference(bars(spark, d), "adj_close").select(*KD, "diff")


@query("price_path", """SELECT symbol, date,
  first_value(adj_close) OVER w * exp(sum(coalesce(log_return, 0)) OVER w) AS price
FROM v_returns WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)""", ["price"], digits=5)
def price_path(spark, d):
    w = series.series_window()
    df = series.add_log_return(bars(spark, d)).withColumns(
        {"p0": F.first("adj_close").over(w), "log_return": F.coalesce("log_return", F.lit(0.0))}
    )
    return series.add_price_path(df, "p0", "log_return", order=("date",)).select(*KD, "price")


@query("overlay_mask", """SELECT symbol, date, adj_close FROM (
  SELECT *, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM v_price) WHERE nxt IS NOT NULL""", ["adj_close"])
def overlay_mask(spark, d):
    return guards.with_successor(bars(spark, d)).select(*KD, "adj_close")


@query("history_window", """SELECT symbol, date, adj_close FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM v_price) WHERE rn <= 200""", ["adj_close"])
def history_window(spark, d):
    return sampling.history_window(bars(spark, d), 200).select(*KD, "adj_close")


@query("calendar_parts", """SELECT symbol, date, CAST(quarter(date) AS INTEGER) AS quarter, CAST(isodow(date) - 1 AS INTEGER) AS dow,
  strftime(date, '%Y-%m-%d') AS day_text FROM v_price""")
def calendar_parts(spark, d):
    return series.add_calendar(bars(spark, d)).select(*KD, "quarter", "dow", cal.format_day("date").alias("day_text"))


@query("business_days", """SELECT symbol, step, day FROM (
  SELECT symbol, day, row_number() OVER (PARTITION BY symbol ORDER BY day) AS step FROM (
    SELECT symbol, last + CAST(i AS INTEGER) AS day
    FROM (SELECT symbol, max(date) AS last FROM v_price GROUP BY symbol), range(1, 68) r(i)) WHERE isodow(day) < 6)
WHERE step <= 30""")
def business_days(spark, d):
    last = bars(spark, d).groupBy("symbol").agg(F.max("date").alias("last"))
    return last.select("symbol", F.posexplode(cal.business_days("last", 30)).alias("step", "day")).select(
        "symbol", (F.col("step") + 1).cast("long").alias("step"), "day"
    )


@query("date_windows", """SELECT DISTINCT date, CAST(date - 7 AS DATE) AS news_from, CAST(date - 180 AS DATE) AS price_from FROM v_price""")
def date_windows(spark, d):
    days = bars(spark, d).select("date").distinct()
    return days.select("date", F.date_sub("date", 7).alias("news_from"), F.date_sub("date", 2 * 90).alias("price_from"))


@query("log_guard", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN ln(l_discount) END AS log_discount,
  exp(-l_tax) AS exp_tax, sqrt(l_quantity) AS root, abs(l_discount - l_tax) AS gap, greatest(l_discount, l_tax) AS top FROM lineitem""",
       ["log_discount", "exp_tax", "root", "gap", "top"])
def log_guard(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", safe_log("l_discount").alias("log_discount"), F.exp(-F.col("l_tax")).alias("exp_tax"),
        F.sqrt("l_quantity").alias("root"), F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        F.greatest("l_discount", "l_tax").alias("top"),
    )


@query("numeric_coerce", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  TRY_CAST(event_type AS DOUBLE) AS not_a_number FROM events""", ["k", "not_a_number"])
def numeric_coerce(spark, d):
    ev = table(spark, d, "events").withColumn("k_text", F.get_json_object("props", "$.k"))
    return ev.select("event_id", as_double("k_text").alias("k"), as_double("event_type").alias("not_a_number"))


@query("numeric_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
       ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
def numeric_columns(spark, d):
    df = table(spark, d, "lineitem")
    return df.select(*columns.numeric_columns(df))


@query("float32_edge", f"SELECT symbol, date, {', '.join(f'CAST({c} AS FLOAT) AS {c}' for c in LAG_COLS)} FROM v_features5", LAG_COLS)
def float32_edge(spark, d):
    return columns.narrow(lags(spark, d), LAG_COLS)


@query("rounding", "SELECT o_orderkey, round(o_totalprice / 7, 6) AS price_share FROM orders", ["price_share"])
def rounding(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 7, 6).alias("price_share"))


@query("chart_projection", "SELECT symbol, date, adj_close AS price FROM v_price", ["price"])
def chart_projection(spark, d):
    return bars(spark, d).select(*KD, F.col("adj_close").alias("price"))


@query("price_dates", "SELECT DISTINCT date FROM v_price")
def price_dates(spark, d):
    # the distinct days of the raw orders: no bar is needed for that
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


@query("price_history", """SELECT * FROM v_price WHERE date >= DATE '1998-06-01' - 180 AND date < DATE '1998-06-01'""", PRICES)
def price_history(spark, d):
    from tapewright.sources.history import price_history as history

    return history(bars(spark, d), "1998-06-01", 90)


@query("span_cardinality", """SELECT symbol, count(*) AS n_rows, count(DISTINCT date) AS n_dates, min(date) AS first_date, max(date) AS last_date,
  CAST(max(date) - min(date) AS INTEGER) AS span_days FROM v_price GROUP BY symbol""")
def span_cardinality(spark, d):
    return guards.span_and_cardinality(bars(spark, d))


@query("guards", """SELECT symbol, 'too_many_rows' AS reason, n AS observed, 'price' AS source
  FROM (SELECT symbol, count(*) AS n FROM v_price GROUP BY 1) WHERE n > 2000
UNION ALL SELECT symbol, 'span_too_long', n, 'price'
  FROM (SELECT symbol, CAST(max(date) - min(date) AS BIGINT) AS n FROM v_price GROUP BY 1) WHERE n > 1825
UNION ALL SELECT symbol, 'too_many_rows', n, 'news' FROM (SELECT symbol, count(*) AS n FROM v_news GROUP BY 1) WHERE n > 2000""")
def guard_violations(spark, d):
    from tapewright.plans.forecast import request_violations
    from tapewright.workloads.views import news

    return request_violations(bars(spark, d), news(spark, d))


@query("symbol_validity", """SELECT DISTINCT o_orderpriority AS symbol, regexp_full_match(o_orderpriority, '[A-Za-z0-9_.^-]+') AS valid FROM orders
UNION SELECT DISTINCT event_type, regexp_full_match(event_type, '[A-Za-z0-9_.^-]+') FROM events""")
def symbol_validity(spark, d):
    names = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol")).distinct().unionByName(
        table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct()).distinct()
    return names.withColumn("valid", symbol_valid("symbol"))


# --- statistics --------------------------------------------------------------------------

@query("describe", "\nUNION ALL ".join(
    f"""SELECT symbol, '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
  quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, max({c}) AS max FROM v_price GROUP BY symbol"""
    for c in PRICES), ["mean", "std", "min", "q25", "q50", "q75", "max"], digits=4)
def describe(spark, d):
    return stats.describe(bars(spark, d), PRICES)


@query("non_null_counts", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS non_null FROM v_features5""" for c in ["adj_close", "log_return", *T5, *LAG_COLS, "quarter", "dow"]))
def non_null_counts(spark, d):
    df = features.create_features(bars(spark, d), 5)
    return stats.non_null_counts(df, ["adj_close", "log_return", *T5, *LAG_COLS, "quarter", "dow"]).drop("type")


@query("corr_matrix", "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM v_known"
    for i, a in enumerate([*OHLC, "volume"]) for b in [*OHLC, "volume"][i + 1:]), ["corr"])
def corr_matrix(spark, d):
    return stats.correlation(returns_known(bars(spark, d)), [*OHLC, "volume"])


_FC = ["log_return", *LAG_COLS, "quarter", "dow"]


@query("feature_corr", "\nUNION ALL ".join(
    f"SELECT symbol, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM v_features5 GROUP BY symbol"
    for i, a in enumerate(_FC) for b in _FC[i + 1:]), ["corr"])
def feature_corr(spark, d):
    return stats.correlation(features.create_features(bars(spark, d), 5), _FC, ["symbol"])


@query("histogram", """SELECT e.symbol, CAST(g.bin AS INTEGER) AS bin, lo + (hi - lo) / 50 * (g.bin - 1) AS bin_left, lo + (hi - lo) / 50 * g.bin AS bin_right,
  coalesce(c.n, 0) AS count
FROM (SELECT symbol, min(log_return) AS lo, max(log_return) AS hi FROM v_known GROUP BY symbol) e
CROSS JOIN range(1, 51) g(bin)
LEFT JOIN (SELECT k.symbol, least(CAST(floor((log_return - lo) / ((hi - lo) / 50)) AS BIGINT) + 1, 50) AS bin, count(*) AS n
  FROM v_known k JOIN (SELECT symbol, min(log_return) AS lo, max(log_return) AS hi FROM v_known GROUP BY symbol) m ON k.symbol = m.symbol
  GROUP BY 1, 2) c ON c.symbol = e.symbol AND c.bin = g.bin""", ["bin_left", "bin_right"])
def histogram(spark, d):
    return stats.histogram(returns_known(bars(spark, d)))


@query("kde", """SELECT s.symbol, CAST(g.point AS INTEGER) AS point, lo + (hi - lo) * g.point / 199 AS x,
  sum(exp(-0.5 * pow((lo + (hi - lo) * g.point / 199 - k.log_return) / bw, 2))) / any_value(n) / (any_value(bw) * sqrt(2 * pi())) AS density,
  sum(exp(-0.5 * pow((lo + (hi - lo) * g.point / 199 - k.log_return) / bw, 2))) / (any_value(bw) * sqrt(2 * pi())) * any_value(hi - lo) / 50 AS scaled
FROM (SELECT symbol, count(*) AS n, min(log_return) AS lo, max(log_return) AS hi,
        stddev_samp(log_return) * pow(CAST(count(*) AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS bw FROM v_known GROUP BY symbol) s
JOIN v_known k ON k.symbol = s.symbol CROSS JOIN range(0, 200) g(point)
GROUP BY s.symbol, g.point, lo, hi""", ["x", "density", "scaled"])
def kde(spark, d):
    return stats.density(returns_known(bars(spark, d)))


_ACF = ", ".join(f"sum(dv * p{k}) / sum(dv * dv) AS a{k}" for k in H30)
_ACFL = ", ".join(f"lag(dv, {k}) OVER w AS p{k}" for k in H30)


@query("acf", f"""SELECT symbol, CAST(lag AS INTEGER) AS lag, acf,
  1.959963984540054 * sqrt((1 + 2 * coalesce(sum(acf * acf) OVER (PARTITION BY symbol ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) AS band
FROM (SELECT symbol, n, unnest(range(1, 31)) AS lag, unnest([{", ".join(f"a{k}" for k in H30)}]) AS acf
  FROM (SELECT symbol, count(*) AS n, {_ACF} FROM (
    SELECT symbol, dv, {_ACFL} FROM (SELECT symbol, date, log_return - avg(log_return) OVER (PARTITION BY symbol) AS dv FROM v_known)
    WINDOW w AS (PARTITION BY symbol ORDER BY date)) GROUP BY symbol))""", ["acf", "band"])
def acf(spark, d):
    return stats.autocorrelation(returns_known(bars(spark, d)))


@query("exploration_averages", """SELECT symbol, date, adj_close, CASE WHEN count(adj_close) OVER w = 10 THEN avg(adj_close) OVER w END AS sma_10
FROM v_known WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING)""", ["adj_close", "sma_10"])
def exploration_averages(spark, d):
    return explore(bars(spark, d))["moving_averages"].drop("ema_10")


# --- order, limits, samples ---------------------------------------------------------------

@query("chronological", "SELECT symbol, date, close FROM v_price ORDER BY date, symbol", ["close"])
def chronological(spark, d):
    return bars(spark, d).select(*KD, "close").orderBy("date", "symbol")


@query("last_row", "SELECT symbol, max(date) AS date, arg_max(adj_close, date) AS adj_close FROM v_price GROUP BY symbol", ["adj_close"])
def last_row(spark, d):
    return sampling.last_rows(bars(spark, d), 1).select(*KD, "adj_close")


@query("forecast_tail", "SELECT symbol, date, log_return FROM v_split30 WHERE is_forecast", ["log_return"])
def forecast_tail(spark, d):
    df = features.create_features(bars(spark, d), 30)
    return split.time_series_split(df, horizon=30).where("is_forecast").select(*KD, "log_return")


@query("seeded_sample", """SELECT symbol, date, open, high, low, close FROM v_price
ORDER BY md5('42|' || symbol || '|' || strftime(date, '%Y-%m-%d')), symbol, date LIMIT 1000""", OHLC)
def seeded_sample(spark, d):
    return sampling.seeded_sample(bars(spark, d), 1000, 42, KD).select(*KD, *OHLC)


@query("background_rows", f"""SELECT symbol, date, {', '.join(LAG_COLS)} FROM (
  SELECT * FROM v_split5 WHERE split = 'test' ORDER BY md5('42|' || symbol || '|' || strftime(date, '%Y-%m-%d')), symbol, date LIMIT 100)
ORDER BY symbol, date LIMIT 50""", LAG_COLS)
def background_rows(spark, d):
    test = split5(spark, d).where("split = 'test'")
    return sampling.head_rows(sampling.seeded_sample(test, 100, 42, KD), KD, 50).select(*KD, *LAG_COLS)


@query("tail_preview", "SELECT symbol, date, adj_close FROM v_price ORDER BY date DESC, symbol DESC LIMIT 10", ["adj_close"])
def tail_preview(spark, d):
    return sampling.head_rows(bars(spark, d), [F.col("date").desc(), F.col("symbol").desc()], 10).select(*KD, "adj_close")


@query("dedupe_last", """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS seq
FROM orders GROUP BY 1, 2""", ["price"])
def dedupe_last(spark, d):
    raw = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    return sampling.dedupe_last(raw)


# --- feature selection, split, folds ------------------------------------------------------

_FEATS = ["log_return", *LAG_COLS, "quarter", "dow"]


@query("feature_selection", f"SELECT symbol, date, {', '.join(_FEATS)} FROM v_features5", ["log_return", *LAG_COLS])
def feature_selection(spark, d):
    df = features.create_features(bars(spark, d), 5)
    return df.select(*KD, *columns.feature_columns(df))


@query("inference_projection", f"SELECT * EXCLUDE ({', '.join(T5)}) FROM v_features5", [*PRICES, "log_return", *LAG_COLS])
def inference_projection(spark, d):
    return columns.drop_targets(features.create_features(bars(spark, d), 5))


@query("split_rows", "SELECT symbol, date, split, is_forecast FROM v_split30")
def split_rows(spark, d):
    df = features.create_features(bars(spark, d), 30)
    return split.time_series_split(df, horizon=30).select(*KD, "split", "is_forecast")


@query("split_sizes", "SELECT symbol, coalesce(split, 'unknown') AS split, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM v_split30 GROUP BY 1, 2")
def split_sizes(spark, d):
    df = split.time_series_split(features.create_features(bars(spark, d), 30), horizon=30)
    return df.groupBy("symbol", F.coalesce("split", F.lit("unknown")).alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def folds_sql(k: int, gap: int = 0) -> str:
    return f"""SELECT symbol, date, log_return, CAST(fold AS INTEGER) AS fold, CASE WHEN pos < start - {gap} THEN 'train' ELSE 'val' END AS role FROM (
  SELECT *, n - ({k} - fold) * size AS start FROM (
    SELECT *, n // {k + 1} AS size FROM (
      SELECT symbol, date, log_return, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n
      FROM v_split5 WHERE split = 'train') CROSS JOIN range(0, {k}) r(fold)))
WHERE pos < start - {gap} OR (pos >= start AND pos < start + size)"""


@query("cv_folds", folds_sql(2), ["log_return"])
def cv_folds(spark, d):
    train = split5(spark, d).where("split = 'train'").select(*KD, "log_return")
    return split.expanding_folds(train, 2)


@query("cv_folds_gap", folds_sql(3, 5), ["log_return"])
def cv_folds_gap(spark, d):
    train = split5(spark, d).where("split = 'train'").select(*KD, "log_return")
    return split.expanding_folds(train, 3, 5)


@query("array_reshape", "\nUNION ALL ".join(
    f"SELECT symbol, date, {h} AS step, target_{h} AS value, {' + '.join(f'target_{i}' for i in range(1, h + 1))} AS running FROM v_split5 WHERE split = 'test'"
    for h in H5), ["value", "running"])
def array_reshape(spark, d):
    """n x 5 matrix -> long -> one array per row -> running sums -> long."""
    test = split5(spark, d).where("split = 'test'")
    stacked = column_stack(ravel(test, KD, T5), KD).withColumn("running", cumulative(F.col("values")))
    return stacked.select(*KD, F.posexplode(F.arrays_zip("values", "running")).alias("step", "p")).select(
        *KD, (F.col("step") + 1).alias("step"), F.col("p.values").alias("value"), F.col("p.running").alias("running"))


@query("unique_date_check", "SELECT symbol, date, count(*) AS count FROM (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders) GROUP BY 1, 2 HAVING count(*) > 1")
def unique_date_check(spark, d):
    raw = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"))
    return joins.duplicate_dates(raw)


# --- ticks: the same operators on series without a calendar bound ---------------------------

TICK = dict(time="ts", tiebreak=["seq"])


@query("tick_index", "SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS pos FROM v_ticks")
def tick_index(spark, d):
    return add_long_position(ticks(spark, d), **TICK).select("symbol", "seq", "pos")


_TICK_LAGS = ", ".join(f"lag(log_return, {k}) OVER w AS lag_{k}" for k in LAGS)
_TICK_LEADS = ", ".join(f"lead(log_return, {h}) OVER w AS target_{h}" for h in H5)


@query("tick_features", f"""SELECT symbol, seq, log_return, {_TICK_LEADS}, {_TICK_LAGS} FROM (
  SELECT *, CASE WHEN value > 0 AND lag(value) OVER w > 0 THEN ln(value / lag(value) OVER w) END AS log_return
  FROM v_ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)) WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)""",
       ["log_return", *T5, *LAG_COLS])
def tick_features(spark, d):
    def steps(df, keys, order):
        df = series.add_log_return(df, keys, order, "value")
        return series.add_lags(series.add_targets(df, 5, keys, order), 7, keys, order)

    out = over_chunks(ticks(spark, d), steps, back=8, ahead=5, **TICK)
    return out.select("symbol", "seq", "log_return", *T5, *LAG_COLS)


@query("tick_rolling", """SELECT symbol, seq, CASE WHEN count(value) OVER a = 10 THEN avg(value) OVER a END AS sma_10,
  CASE WHEN count(value) OVER b = 20 THEN stddev_samp(value) OVER b END AS volatility
FROM v_ticks WINDOW a AS (PARTITION BY symbol ORDER BY ts, seq ROWS 9 PRECEDING), b AS (PARTITION BY symbol ORDER BY ts, seq ROWS 19 PRECEDING)""",
       ["sma_10", "volatility"])
def tick_rolling(spark, d):
    def steps(df, keys, order):
        df = series.add_moving_average(df, "value", 10, "sma_10", keys, order)
        return series.add_rolling_volatility(df, "value", 20, "volatility", keys, order)

    return over_chunks(ticks(spark, d), steps, back=19, **TICK).select("symbol", "seq", "sma_10", "volatility")


@query("tick_running_sum", "SELECT symbol, seq, sum(value) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS total FROM v_ticks", ["total"], digits=4)
def tick_running_sum(spark, d):
    placed = add_long_position(ticks(spark, d), **TICK)
    return running_sum(placed, "value", "total").select("symbol", "seq", "total")


@query("tick_ema", """SELECT a.symbol, a.seq,
  sum(b.value * pow(CAST(9 AS DOUBLE) / 11, a.pos - b.pos)) / sum(pow(CAST(9 AS DOUBLE) / 11, a.pos - b.pos)) AS ema
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS pos FROM v_ticks) a
JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS pos FROM v_ticks) b
  ON a.symbol = b.symbol AND b.pos <= a.pos AND b.pos >= a.pos - 200
GROUP BY a.symbol, a.seq""", ["ema"])
def tick_ema(spark, d):
    placed = add_long_position(ticks(spark, d), **TICK)
    return add_long_ema(placed, "value", 10).select("symbol", "seq", "ema")


@query("tick_acf", f"""SELECT symbol, CAST(lag AS INTEGER) AS lag, acf,
  1.959963984540054 * sqrt((1 + 2 * coalesce(sum(acf * acf) OVER (PARTITION BY symbol ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) AS band
FROM (SELECT symbol, n, unnest(range(1, 31)) AS lag, unnest([{", ".join(f"a{k}" for k in H30)}]) AS acf
  FROM (SELECT symbol, count(*) AS n, {_ACF} FROM (
    SELECT symbol, dv, {_ACFL} FROM (SELECT symbol, ts, seq, value - avg(value) OVER (PARTITION BY symbol) AS dv FROM v_ticks WHERE value IS NOT NULL)
    WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)) GROUP BY symbol))""", ["acf", "band"])
def tick_acf(spark, d):
    return stats.long_autocorrelation(ticks(spark, d), "value", **TICK)
