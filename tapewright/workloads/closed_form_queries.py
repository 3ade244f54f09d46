"""Models with one input: their elastic-net solution has a closed form, so SQL can check the whole path.

On standardised data with correlation c the weight is sign(c) * max(|c| - alpha * l1, 0) / (1 + alpha * (1 - l1)).
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapewright.models.boosted_trees import BoostedTrees
from tapewright.models.elastic_net import ElasticNet
from tapewright.models.spaces import sample
from tapewright.operators import sampling
from tapewright.operators.quantiles import exact_quantiles, sketched_quantiles
from tapewright.plans import explain, forecast, training, tuning
from tapewright.session import stage
from tapewright.workloads.model_queries import panel5
from tapewright.workloads.registry import H5, query
from tapewright.workloads.series_queries import KD, T5, split5
from tapewright.workloads.views import bars, news, ticks

ALPHA, L1 = 0.005, 0.4
TRIALS, SEED = 30, 7
SPACE = sample(ElasticNet.search_space(), TRIALS, SEED)


def weight_sql(c: str, alpha, l1) -> str:
    a, b = f"CAST({alpha} AS DOUBLE)", f"CAST({l1} AS DOUBLE)"
    return f"sign({c}) * greatest(abs({c}) - {a} * {b}, 0) / (1 + {a} * (1 - {b}))"


def long_sql(source: str, keep: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {keep}, log_return AS x, {h} AS h, target_{h} AS y FROM {source}" for h in H5) + ")"


def stats_sql(source: str, group: str) -> str:
    """Moments of input and target per group and horizon."""
    return f"""(SELECT {group}, h, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy,
  (avg(x * y) - avg(x) * avg(y)) / (stddev_pop(x) * stddev_pop(y)) AS c FROM {source} GROUP BY {group}, h)"""


_TRAIN = long_sql("v_split5 WHERE split = 'train'", "symbol")
_COEF = f"""(SELECT symbol, h, w * sy / sx AS w, my - w * sy / sx * mx AS b FROM (
  SELECT *, {weight_sql('c', ALPHA, L1)} AS w FROM {stats_sql(_TRAIN, 'symbol')}))"""


def by_series(df):
    net = ElasticNet(alpha=ALPHA, l1_ratio=L1, scope=("symbol",))
    return net.fit(df.where("split = 'train'"), ["log_return"], T5)


@query("net_coefficients", f"""SELECT symbol, CAST(h AS INTEGER) AS horizon, 'log_return' AS feature, w AS weight FROM {_COEF}
UNION ALL SELECT symbol, CAST(h AS INTEGER), '(intercept)', b FROM {_COEF}""", ["weight"])
def net_coefficients(spark, d):
    df = stage(split5(spark, d), "features")
    return by_series(df).coefficients().drop("scaled_weight")


@query("net_predictions", f"""SELECT f.symbol, f.date, CAST(f.h AS INTEGER) AS horizon, f.y AS y_true, k.b + k.w * f.x AS y_pred
FROM {long_sql("v_split5 WHERE split = 'test'", "symbol, date")} f JOIN {_COEF} k ON k.symbol = f.symbol AND k.h = f.h""", ["y_true", "y_pred"])
def net_predictions(spark, d):
    df = stage(split5(spark, d), "features")
    return training.predict_long(by_series(df), df.where("split = 'test'"), T5, KD)


@query("net_forecast", f"""SELECT l.symbol, CAST(k.h AS INTEGER) AS step, k.b + k.w * l.log_return AS log_return,
  l.adj_close * exp(sum(k.b + k.w * l.log_return) OVER (PARTITION BY l.symbol ORDER BY k.h)) AS price
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM v_features5) l
JOIN {_COEF} k ON k.symbol = l.symbol WHERE l.rn = 1""", ["log_return", "price"], digits=4)
def net_forecast(spark, d):
    """From bars to price paths with a fitted model per series."""
    df = stage(split5(spark, d), "features")
    path = forecast.batch_forecast(bars(spark, d), None, by_series(df), 5, limits=False)
    return forecast.explode_path(path).drop("date")


_NEWS = """(SELECT f.*, coalesce(d.pos_minus_neg, median(d.pos_minus_neg) FILTER (WHERE f.split = 'train') OVER (PARTITION BY f.symbol)) AS mood
FROM v_split5 f LEFT JOIN v_daily d ON d.symbol = f.symbol AND d.date = f.date)"""
_MOOD = "(" + " UNION ALL ".join(f"SELECT symbol, mood AS x, {h} AS h, target_{h} AS y FROM {_NEWS} WHERE split = 'train'" for h in H5) + ")"
_MOOD_COEF = f"""(SELECT symbol, h, w * sy / sx AS w, my - w * sy / sx * mx AS b FROM (
  SELECT *, {weight_sql('c', ALPHA, L1)} AS w FROM {stats_sql(_MOOD, 'symbol')}))"""
_MOOD_LAST = f"""(SELECT f.symbol, f.adj_close, coalesce(d.pos_minus_neg, m.mid) AS x
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM v_features5) f
JOIN (SELECT t.symbol, median(d.pos_minus_neg) AS mid FROM v_split5 t JOIN v_daily d ON d.symbol = t.symbol AND d.date = t.date WHERE t.split = 'train' GROUP BY t.symbol) m ON m.symbol = f.symbol
LEFT JOIN v_daily d ON d.symbol = f.symbol AND d.date = f.date WHERE f.rn = 1)"""


@query("news_forecast", f"""SELECT l.symbol, CAST(k.h AS INTEGER) AS step, k.b + k.w * l.x AS log_return,
  l.adj_close * exp(sum(k.b + k.w * l.x) OVER (PARTITION BY l.symbol ORDER BY k.h)) AS price
FROM {_MOOD_LAST} l JOIN {_MOOD_COEF} k ON k.symbol = l.symbol""", ["log_return", "price"], digits=4)
def news_forecast(spark, d):
    """From bars and raw headlines to price paths, with a model of the daily polarity per series."""
    df = stage(panel5(spark, d), "panel")
    net = ElasticNet(alpha=ALPHA, l1_ratio=L1, scope=("symbol",)).fit(df.where("split = 'train'"), ["pos_minus_neg"], T5)
    path = forecast.batch_forecast(bars(spark, d), news(spark, d), net, 5)
    return forecast.explode_path(path).drop("date")


_FOLD_ROWS = """(SELECT *, CASE WHEN pos < n - (2 - fold) * (n // 3) THEN 'train' ELSE 'val' END AS role FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n
  FROM v_split5 WHERE split = 'train') CROSS JOIN range(0, 2) r(fold) WHERE pos < n - (2 - fold) * (n // 3) + n // 3)"""
_FIT = stats_sql(long_sql(f"{_FOLD_ROWS} WHERE role = 'train'", "fold"), "fold")
_PARAMS = "(VALUES " + ", ".join(f"({i}, {p['alpha']!r}, {p['l1_ratio']!r})" for i, p in enumerate(SPACE)) + ") p(trial, alpha, l1)"
_ALL = f"""(SELECT trial, v.fold, sqrt(avg((y - (my + w * sy / sx * (x - mx))) * (y - (my + w * sy / sx * (x - mx))))) AS score
FROM {long_sql(f"{_FOLD_ROWS} WHERE role = 'val'", "fold")} v JOIN (
  SELECT trial, s.*, sign(c) * greatest(abs(c) - CAST(alpha AS DOUBLE) * CAST(l1 AS DOUBLE), 0) / (1 + CAST(alpha AS DOUBLE) * (1 - CAST(l1 AS DOUBLE))) AS w
  FROM {_FIT} s CROSS JOIN {_PARAMS}) k ON k.fold = v.fold AND k.h = v.h GROUP BY trial, v.fold)"""


@query("net_tuning", f"""SELECT CAST(trial AS INTEGER) AS trial, CAST(fold AS INTEGER) AS fold, score FROM {_ALL} a WHERE fold = 0 OR trial IN (
  SELECT trial FROM {_ALL} b WHERE fold = 0 ORDER BY score, trial LIMIT {math.ceil(TRIALS / tuning.REDUCTION)})""", ["score"], digits=8)
def net_tuning(spark, d):
    """Every trial on the first fold, the best third on the second."""
    train = stage(split5(spark, d).where("split = 'train'"), "features")
    return tuning.tune_elastic_net(train, ["log_return"], T5, ElasticNet(seed=SEED), trials=TRIALS).trials.select("trial", "fold", "score")


_POOLED = f"""(SELECT h, w * sy / sx AS w, my - w * sy / sx * mx AS b FROM (
  SELECT *, {weight_sql('c', ALPHA, L1)} AS w FROM {stats_sql(_TRAIN.replace("SELECT symbol", "SELECT 1 AS one"), 'one')}))"""
_GROUND = """(SELECT avg(log_return) AS m FROM (SELECT * FROM v_split5 WHERE split = 'test'
  ORDER BY md5('42|' || symbol || '|' || strftime(date, '%Y-%m-%d')), symbol, date LIMIT 100))"""


@query("net_attributions", f"""SELECT t.symbol, t.date, CAST(k.h AS INTEGER) AS horizon, 'log_return' AS feature, k.w * (t.log_return - g.m) AS phi, k.b + k.w * g.m AS base
FROM v_split5 t, {_POOLED} k, {_GROUND} g WHERE t.split = 'test'""", ["phi", "base"], digits=7)
def net_attributions(spark, d):
    """Linear attributions against a seeded background of 100 rows."""
    df = stage(split5(spark, d), "features")
    test = df.where("split = 'test'")
    model = ElasticNet(alpha=ALPHA, l1_ratio=L1).fit(df.where("split = 'train'"), ["log_return"], T5)
    return explain.linear_attribution(model, test, sampling.seeded_sample(test, 100, 42, KD), KD)


# --- hard inputs ------------------------------------------------------------------------------

LEVEL = 1e6


@query("net_tuning_level", f"""SELECT CAST(trial AS INTEGER) AS trial, CAST(fold AS INTEGER) AS fold, score FROM {_ALL} a WHERE fold = 0 OR trial IN (
  SELECT trial FROM {_ALL} b WHERE fold = 0 ORDER BY score, trial LIMIT {math.ceil(TRIALS / tuning.REDUCTION)})""", ["score"], digits=6)
def net_tuning_level(spark, d):
    """Scores do not change when all targets are raised by a large level."""
    train = stage(split5(spark, d).where("split = 'train'").withColumns({t: F.col(t) + LEVEL for t in T5}), "features")
    return tuning.tune_elastic_net(train, ["log_return"], T5, ElasticNet(seed=SEED), trials=TRIALS).trials.select("trial", "fold", "score")


@query("net_unseen_series", f"""SELECT f.symbol, f.date, CAST(f.h AS INTEGER) AS horizon, f.y AS y_true, k.b + k.w * f.x AS y_pred
FROM {long_sql("v_split5 WHERE split = 'test'", "symbol, date")} f LEFT JOIN {_COEF} k ON k.symbol = f.symbol AND k.h = f.h AND k.symbol <> '5-LOW'""", ["y_true", "y_pred"])
def net_unseen_series(spark, d):
    """A series left out of training keeps its rows, without predictions."""
    df = stage(split5(spark, d), "features")
    return training.predict_long(by_series(df.where("symbol <> '5-LOW'")), df.where("split = 'test'"), T5, KD)


_OF_SERIES = """(SELECT symbol, avg(log_return) AS m FROM v_split5 WHERE split = 'test' GROUP BY symbol)"""


@query("net_attributions_by_series", f"""SELECT t.symbol, t.date, CAST(k.h AS INTEGER) AS horizon, 'log_return' AS feature, k.w * (t.log_return - g.m) AS phi, k.b + k.w * g.m AS base
FROM v_split5 t JOIN {_COEF} k ON k.symbol = t.symbol JOIN {_OF_SERIES} g ON g.symbol = t.symbol WHERE t.split = 'test'""", ["phi", "base"], digits=7)
def net_attributions_by_series(spark, d):
    """Attributions of a model per series, against all test rows of the series."""
    df = stage(split5(spark, d), "features")
    test = df.where("split = 'test'")
    return explain.linear_attribution(by_series(df), test, test, KD)


@query("net_shap_summary", f"""SELECT CAST(k.h AS INTEGER) AS horizon, 'log_return' AS feature, avg(abs(k.w * (t.log_return - g.m))) AS importance, CAST(1 AS INTEGER) AS rank
FROM v_split5 t, {_POOLED} k, {_GROUND} g WHERE t.split = 'test' GROUP BY k.h""", ["importance"], digits=7)
def net_shap_summary(spark, d):
    return explain.summarise(net_attributions(spark, d))


_FIRST_ROWS = """(SELECT avg(log_return) AS m FROM (SELECT * FROM v_split5 WHERE split = 'test' ORDER BY symbol, date LIMIT 50))"""


@query("kernel_linear", f"""SELECT t.symbol, t.date, CAST(k.h AS INTEGER) AS horizon, 'log_return' AS feature, k.w * (t.log_return - g.m) AS phi, k.b + k.w * g.m AS base
FROM v_split5 t, {_POOLED} k, {_FIRST_ROWS} g WHERE t.split = 'test'""", ["phi", "base"], digits=7)
def kernel_linear(spark, d):
    """Attributions by coalitions equal the closed form where the model is linear."""
    df = stage(split5(spark, d), "features")
    test = df.where("split = 'test'")
    model = ElasticNet(alpha=ALPHA, l1_ratio=L1).fit(df.where("split = 'train'"), ["log_return"], T5)
    return explain.coalition_attribution(model, test, test, KD)


# --- a tree with one split has a closed form: the mean target on either side ------------------

_RISES = "(SELECT *, CASE WHEN log_return > 0 THEN 1 ELSE 0 END AS up FROM v_split5 WHERE log_return IS NOT NULL)"
_STUMP = f"""(SELECT up, h, avg(y) AS v FROM ({" UNION ALL ".join(f"SELECT up, {h} AS h, target_{h} AS y FROM {_RISES} WHERE split = 'train'" for h in H5)}) GROUP BY up, h)"""


def stump(spark, d):
    """Rows with a rise or not and a constant input, and a tree with one split per horizon."""
    df = split5(spark, d).where("log_return IS NOT NULL")
    df = stage(df.withColumn("up", (F.col("log_return") > 0).cast("double")).withColumn("flat", F.lit(1.0)), "rises")
    trees = BoostedTrees(horizon=5, n_estimators=1, max_depth=1, subsample=1.0, colsample_bytree=1.0)
    return df, trees.fit(df.where("split = 'train'"), ["up", "flat"], T5)


@query("stump_predictions", f"""SELECT f.symbol, f.date, CAST(k.h AS INTEGER) AS horizon, CASE k.h {" ".join(f"WHEN {h} THEN f.target_{h}" for h in H5)} END AS y_true, k.v AS y_pred
FROM {_RISES} f JOIN {_STUMP} k ON k.up = f.up WHERE f.split = 'test'""", ["y_true", "y_pred"], digits=8)
def stump_predictions(spark, d):
    df, model = stump(spark, d)
    return training.predict_long(model, df.where("split = 'test'"), T5, KD)


@query("stump_attributions", f"""SELECT f.symbol, f.date, CAST(k.h AS INTEGER) AS horizon, n.feature, CASE n.feature WHEN 'up' THEN k.v - g.m ELSE 0 END AS phi, g.m AS base
FROM {_RISES} f JOIN {_STUMP} k ON k.up = f.up
JOIN (SELECT s.h, avg(s.v) AS m FROM (SELECT up FROM {_RISES} WHERE split = 'test' ORDER BY symbol, date LIMIT 50) b JOIN {_STUMP} s ON s.up = b.up GROUP BY s.h) g ON g.h = k.h
CROSS JOIN (VALUES ('up'), ('flat')) n(feature) WHERE f.split = 'test'""", ["phi", "base"], digits=8)
def stump_attributions(spark, d):
    """All horizons, the whole test set: the tree is only asked for predictions."""
    df, model = stump(spark, d)
    test = df.where("split = 'test'")
    return explain.coalition_attribution(model, test, test, KD)


_PRICES = "(SELECT CASE WHEN o_orderkey % 40 = 0 THEN CAST('inf' AS DOUBLE) WHEN o_orderkey % 50 = 1 THEN CAST('-inf' AS DOUBLE) ELSE CAST(o_totalprice AS DOUBLE) END AS x FROM orders)"


@query("quantiles_infinite", f"""SELECT quantile_cont(x, CAST(0.1 AS DOUBLE)) AS q10, quantile_cont(x, CAST(0.5 AS DOUBLE)) AS q50, quantile_cont(x, CAST(0.9 AS DOUBLE)) AS q90, max(x) = CAST('inf' AS DOUBLE) AS top FROM {_PRICES}""", ["q10", "q50", "q90"], digits=4)
def quantiles_infinite(spark, d):
    """Exact quantiles of a column with infinite values, by sketches and brackets."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    x = F.when(key % 40 == 0, F.lit(math.inf)).when(key % 50 == 1, F.lit(-math.inf)).otherwise(price)
    df = spark.read.parquet(f"{d}/orders.parquet").select(x.alias("x"))
    q10, q50, q90, top = exact_quantiles(df, ["x"], [0.1, 0.5, 0.9, 1.0], small=500)["x"]
    return spark.createDataFrame([(q10, q50, q90, top == math.inf)], "q10 double, q50 double, q90 double, top boolean")


_LINES = ("l_quantity", "l_extendedprice", "l_discount")
_SHARES = (0.01, 0.25, 0.5, 0.75, 0.999)


def _quantiles_sql(source: str, columns, key: str) -> str:
    of = lambda c: ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), CAST({p} AS DOUBLE)) AS q{i}" for i, p in enumerate(_SHARES))
    return "\nUNION ALL ".join(f"SELECT {key}'{c}' AS \"column\", count({c}) AS n, {of(c)} FROM {source}{' GROUP BY 1' if key else ''}" for c in columns)


def _wide():
    return [F.col("q")[i].alias(f"q{i}") for i in range(len(_SHARES))]


@query("column_quantiles", _quantiles_sql("lineitem", _LINES, ""), [f"q{i}" for i in range(len(_SHARES))])
def column_quantiles(spark, d):
    """Exact quantiles of whole columns: a sketch pass, and one that resolves its brackets."""
    found = sketched_quantiles(spark.read.parquet(f"{d}/lineitem.parquet"), _LINES, _SHARES, small=1000)
    return found.select("column", "n", *_wide())


@query("tick_quantiles", _quantiles_sql("v_ticks", ("value",), "symbol, "), [f"q{i}" for i in range(len(_SHARES))])
def tick_quantiles(spark, d):
    """The same for every series, of any length."""
    found = sketched_quantiles(ticks(spark, d), ["value"], _SHARES, ["symbol"])
    return found.select("symbol", "column", "n", *_wide())
