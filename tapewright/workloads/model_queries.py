"""Queries on preparation, baselines, models, forecasts and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.models.base import Experiment
from tapewright.models.boosted_trees import BoostedTrees, FittedTrees
from tapewright.models.elastic_net import ElasticNet, FittedElasticNet
from tapewright.models.naive import FittedNaive
from tapewright.operators import columns, features, guards, metrics, prep, split, stats
from tapewright.operators.gram import gram_entries, gram_table
from tapewright.plans import explain, forecast, training, tuning
from tapewright.session import stage, stage_path
from tapewright.sinks.tables import write_metrics, write_stage
from tapewright.sources import files
from tapewright.workloads.news_queries import daily
from tapewright.workloads.registry import H5, H30, query
from tapewright.workloads.series_queries import KD, LAG_COLS, T5, T30, split5
from tapewright.workloads.views import bars, news

MODEL_INPUTS = ["log_return", *LAG_COLS, "quarter", "dow"]
INPUTS = prep.Inputs.of(["log_return", *LAG_COLS], ["dow", "quarter"])
ERRORS = list(metrics.METRICS)


def error_sql(y: str, p: str) -> str:
    return f"""avg(abs({y} - {p})) AS mae, avg(({y} - {p}) * ({y} - {p})) AS mse, sqrt(avg(({y} - {p}) * ({y} - {p}))) AS rmse,
  avg(2 * abs({p} - {y}) / (abs({y}) + abs({p}) + 1e-12)) AS smape,
  1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*)) AS r2"""


def long_sql(source: str, horizons: range, where: str, keep: str = "symbol, date, log_return") -> str:
    parts = " UNION ALL ".join(f"SELECT {keep}, {h} AS horizon, target_{h} AS y FROM {source} WHERE {where}" for h in horizons)
    return f"({parts})"


TEST30 = long_sql("v_split30", H30, "split = 'test'")
TEST5 = long_sql("v_split5", H5, "split = 'test'")


def panel5(spark, d):
    """Features with sentiment, five targets and the split."""
    merged = features.merged_panel(bars(spark, d), daily(spark, d))
    return split.time_series_split(features.create_features(merged, 5), horizon=5)


def panel30(spark, d):
    """Features with sentiment, thirty targets and the split: the reference setting of models."""
    merged = features.merged_panel(bars(spark, d), daily(spark, d))
    return split.time_series_split(features.create_features(merged, 30), horizon=30)


# --- preparation ---------------------------------------------------------------------------

def _stat_sql(c: str, i: int) -> str:
    x = f"coalesce({c}, (SELECT median({c}) FROM t))"
    return f"""SELECT {i} AS position, '{c}' AS feature, (SELECT median({c}) FROM t) AS median, avg({x}) AS mean, stddev_pop({x}) AS std FROM t"""


def _mode_sql(c: str, i: int) -> str:
    return f"""SELECT {i} AS position, '{c}' AS feature, CAST((SELECT {c} FROM t GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS DOUBLE) AS median,
  CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std"""


_NUM, _CAT = INPUTS.numeric, INPUTS.categorical
_TRAIN = "(SELECT * FROM v_split5 WHERE split = 'train')"
_PREP = " UNION ALL ".join([_stat_sql(c, i) for i, c in enumerate(_NUM)] + [_mode_sql(c, len(_NUM) + i) for i, c in enumerate(_CAT)])


@query("prep_stats", f"SELECT * FROM (WITH t AS {_TRAIN} {_PREP})", ["median", "mean", "std"])
def prep_stats(spark, d):
    train = stage(split5(spark, d).where("split = 'train'"), "train")  # several passes read it
    return prep.prep_stats(train, INPUTS)


@query("prep_stats_by_series", "\nUNION ALL ".join(
    f"""SELECT symbol, {i} AS position, '{c}' AS feature, any_value(med) AS median, avg(coalesce(x, med)) AS mean, stddev_pop(coalesce(x, med)) AS std FROM (
  SELECT symbol, {c} AS x, median({c}) OVER (PARTITION BY symbol) AS med FROM v_split5 WHERE split = 'train') GROUP BY symbol""" for i, c in enumerate(_NUM)),
    ["median", "mean", "std"])
def prep_stats_by_series(spark, d):
    train = split5(spark, d).where("split = 'train'")
    return prep.prep_stats(train, prep.Inputs.of(_NUM), ["symbol"])


@query("category_levels", "\nUNION ALL ".join(
    f"SELECT DISTINCT symbol, '{c}' AS feature, {c} AS level FROM v_split5 WHERE split = 'train'" for c in _CAT))
def category_levels(spark, d):
    return prep.seen_levels(split5(spark, d).where("split = 'train'"), INPUTS, ["symbol"])


_SCALED = ", ".join(f"(coalesce(u.{c}, s.m_{c}) - s.a_{c}) / s.s_{c} AS {c}" for c in _NUM)
_ONEHOT = ", ".join(f"CASE WHEN u.{c} = {v} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS {c}_{v}" for c, vs in INPUTS.levels for v in vs)
_MEDS = ", ".join(f"median({c}) AS m_{c}" for c in _NUM)
_MOMENTS = ", ".join(f"avg(coalesce(t.{c}, m.m_{c})) AS a_{c}, stddev_pop(coalesce(t.{c}, m.m_{c})) AS s_{c}, any_value(m.m_{c}) AS m_{c}" for c in _NUM)


@query("transformed_features", f"""SELECT u.symbol, u.date, {_SCALED}, {_ONEHOT} FROM v_split5 u,
 (SELECT {_MOMENTS} FROM {_TRAIN} t, (SELECT {_MEDS} FROM {_TRAIN} q) m) s""", INPUTS.encoded)
def transformed_features(spark, d):
    """Imputed with training medians, scaled with training moments, one-hot coded."""
    df = stage(split5(spark, d), "features")  # several passes read it
    train = df.where("split = 'train'")
    fill = prep.fill_values(train, INPUTS)
    scale = prep.scale_stats(prep.encode(train, INPUTS, fill, []), INPUTS)
    return prep.standardise(prep.encode(df, INPUTS, fill, KD), INPUTS, scale, KD)


@query("target_scaling", "\nUNION ALL ".join(
    f"""SELECT f.symbol, f.date, '{t}' AS target, (f.{t} - s.m) / s.sd AS scaled, f.{t} AS restored
FROM v_split5 f JOIN (SELECT symbol, avg({t}) AS m, stddev_pop({t}) AS sd FROM v_split5 WHERE split = 'train' GROUP BY symbol) s ON s.symbol = f.symbol
WHERE f.split = 'test'""" for t in T5), ["scaled", "restored"])
def target_scaling(spark, d):
    df = split5(spark, d)
    scale = prep.target_scale(df.where("split = 'train'"), T5, ["symbol"])
    long = stats.to_long(df.where("split = 'test'"), KD, T5, "target", "y").join(scale, ["symbol", "target"])
    scaled = prep.scale_target(F.col("y"), F.col("mean"), F.col("std"))
    out = long.withColumn("scaled", scaled)
    return out.select(*KD, "target", "scaled", prep.unscale_target(F.col("scaled"), F.col("mean"), F.col("std")).alias("restored"))


_GN = ["1", *LAG_COLS, *T5]
_GC = {"1": "CAST(1 AS DOUBLE)", **{c: f"coalesce({c}, 0)" for c in LAG_COLS}, **{t: t for t in T5}}


@query("gram_matrix", "\nUNION ALL ".join(
    f"SELECT symbol, '{a}' AS a, '{b}' AS b, sum({_GC[a]} * {_GC[b]}) AS value FROM v_split5 WHERE split = 'train' GROUP BY symbol"
    for i, a in enumerate(_GN) for b in _GN[i:]), ["value"])
def gram_matrix(spark, d):
    train = split5(spark, d).where("split = 'train'")
    x = [F.coalesce(F.col(c), F.lit(0.0)) for c in LAG_COLS]
    grams = gram_table(train, ["symbol"], x, [F.col(t) for t in T5])
    return gram_entries(grams, ["symbol"], [*LAG_COLS, *T5])


# --- baselines and metrics ------------------------------------------------------------------

@query("naive_metrics", f"SELECT symbol, {error_sql('y', '0')} FROM {TEST30} GROUP BY symbol", ERRORS)
def naive_metrics(spark, d):
    """Zero-return forecast, errors pooled over 30 horizons, per series."""
    df = split.time_series_split(features.create_features(bars(spark, d), 30), horizon=30)
    return training.evaluate(FittedNaive(30), df.where("split = 'test'"), T30, ["symbol"])


@query("pooled_metrics", f"SELECT {error_sql('y', '(-0.5 * coalesce(log_return, 0))')} FROM {TEST5}", ERRORS)
def pooled_metrics(spark, d):
    return training.evaluate(FittedNaive(5, -0.5), split5(spark, d).where("split = 'test'"), T5)


@query("mase", f"""SELECT a.symbol, a.mae, b.scale, a.mae / b.scale AS mase
FROM (SELECT symbol, avg(abs(y)) AS mae FROM {TEST5} GROUP BY symbol) a
JOIN (SELECT symbol, greatest(avg(abs(step)), 1e-8) AS scale FROM (
  SELECT symbol, target_1 - lag(target_1) OVER (PARTITION BY symbol ORDER BY date) AS step FROM v_split5 WHERE split = 'train') GROUP BY symbol) b
ON a.symbol = b.symbol""", ["mae", "scale", "mase"])
def mase(spark, d):
    df = split5(spark, d)
    pairs = training.predict_long(FittedNaive(5), df.where("split = 'test'"), T5, ["symbol"])
    return metrics.mase(pairs, df.where("split = 'train'"), "target_1")


VARIANTS = {"without": 0.0, "with": -0.5}
_MET = " UNION ALL ".join(f"SELECT symbol AS name, '{v}' AS sentiment, {error_sql('y', f'({f} * coalesce(log_return, 0))')} FROM {TEST5} GROUP BY symbol" for v, f in VARIANTS.items())


def variant_metrics(spark, d):
    """Two forecasters' metric tables per series, tagged and put on top of each other."""
    test = split5(spark, d).where("split = 'test'")
    parts = [metrics.tag(training.evaluate(FittedNaive(5, f), test, T5, ["symbol"]), "sentiment", v) for v, f in VARIANTS.items()]
    return parts[0].unionByName(parts[1]).withColumnRenamed("symbol", "name")


@query("metric_concat", _MET, ERRORS)
def metric_concat(spark, d):
    return variant_metrics(spark, d)


_PIVOT = ", ".join(f"round(max(CASE WHEN sentiment = '{v}' THEN {m} END), 6) AS {m}_{v}" for m in ERRORS for v in ("with", "without"))


@query("metric_pivot", f"SELECT name, {_PIVOT} FROM ({_MET}) GROUP BY name", [f"{m}_{v}" for m in ERRORS for v in ("with", "without")])
def metric_pivot(spark, d):
    return metrics.compare(variant_metrics(spark, d), ["name"], "sentiment", ["with", "without"])


_IMPR = ", ".join(f"{m}_without - {m}_with AS {m}_impr" for m in ERRORS if m != "r2") + ", r2_with - r2_without AS r2_impr"


@query("improvement", f"SELECT name, {_IMPR} FROM (SELECT name, {_PIVOT} FROM ({_MET}) GROUP BY name)", [f"{m}_impr" for m in ERRORS])
def improvement(spark, d):
    return metrics.improvement(metric_pivot(spark, d), ["name"])


@query("metrics_csv", _MET.replace("symbol AS name, '", "symbol || '/' || '").replace("' AS sentiment", "' AS name"), ERRORS)
def metrics_csv(spark, d):
    """One metric CSV per variant, read back as one table."""
    paths = []
    for v in VARIANTS:
        part = variant_metrics(spark, d).where(F.col("sentiment") == v)
        paths.append(write_metrics(part.select(F.concat_ws("/", "name", "sentiment").alias("name"), *ERRORS), stage_path(spark, f"metrics-{v}")))
    return files.read_metrics(spark, paths)


@query("test_features_parquet", f"SELECT symbol, date, {', '.join(LAG_COLS)}, quarter, dow FROM v_split5 WHERE split = 'test'", LAG_COLS)
def test_features_parquet(spark, d):
    test = split5(spark, d).where("split = 'test'").select(*KD, *LAG_COLS, "quarter", "dow")
    return files.read_stage(spark, write_stage(test, stage_path(spark, "X-test")))


# --- trials: a grid of shrinkage factors, scored by fold --------------------------------------

GRID = [round(-1.0 + 0.1 * i, 1) for i in range(21)]
_FOLDS = """(SELECT *, n - (2 - fold) * (n // 3) AS start FROM (
  SELECT symbol, date, log_return, target_1, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n
  FROM v_split5 WHERE split = 'train') CROSS JOIN range(0, 2) r(fold))"""
_SCORES = " UNION ALL ".join(
    f"""SELECT {i} AS trial, CAST(fold AS INTEGER) AS fold, sqrt(avg((target_1 - CAST({g} AS DOUBLE) * coalesce(log_return, 0)) * (target_1 - CAST({g} AS DOUBLE) * coalesce(log_return, 0)))) AS score
FROM {_FOLDS} WHERE pos >= start AND pos < start + n // 3 GROUP BY fold""" for i, g in enumerate(GRID))
_VALUES = f"SELECT CAST(trial AS INTEGER) AS trial, avg(score) AS value FROM ({_SCORES}) GROUP BY trial"


def grid_scores(spark, d):
    """(trial, fold, score): every factor on every validation fold, in one aggregation."""
    folds = split.expanding_folds(split5(spark, d).where("split = 'train'").select(*KD, "log_return", "target_1"), 2).where("role = 'val'")
    x = F.coalesce("log_return", F.lit(0.0))
    errors = [F.sqrt(F.avg((F.col("target_1") - g * x) * (F.col("target_1") - g * x))).alias(f"s{i}") for i, g in enumerate(GRID)]
    wide = folds.groupBy("fold").agg(*errors)
    return wide.select("fold", F.inline(F.array(*[F.struct(F.lit(i).alias("trial"), F.col(f"s{i}").alias("score")) for i in range(len(GRID))])))


@query("cv_scores", _VALUES, ["value"])
def cv_scores(spark, d):
    return metrics.fold_scores(grid_scores(spark, d), ["trial"], "rmse")


@query("best_trial", f"SELECT arg_min(trial, value) AS trial, min(value) AS value FROM ({_VALUES})", ["value"])
def best_trial(spark, d):
    return metrics.best_trial(metrics.fold_scores(grid_scores(spark, d), ["trial"], "rmse"))


@query("trial_history", f"""SELECT trial, value, min(value) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) AS best_so_far, cume_dist() OVER (ORDER BY value) AS edf
FROM ({_VALUES})""", ["value", "best_so_far", "edf"])
def trial_history(spark, d):
    return tuning.history(metrics.fold_scores(grid_scores(spark, d), ["trial"], "rmse"))


@query("trial_slices", f"SELECT v.trial, g.factor, v.value FROM ({_VALUES}) v JOIN (VALUES {', '.join(f'({i}, CAST({g} AS DOUBLE))' for i, g in enumerate(GRID))}) g(trial, factor) ON g.trial = v.trial", ["factor", "value"])
def trial_slices(spark, d):
    """Trial value against its parameter: the table behind slice and contour charts."""
    grid = spark.createDataFrame(list(enumerate(GRID)), "trial int, factor double")
    return metrics.fold_scores(grid_scores(spark, d), ["trial"], "rmse").join(F.broadcast(grid), "trial").select("trial", "factor", "value")


# --- overlays and forecasts with the baselines -------------------------------------------------

BASELINES = {"zero": FittedNaive(5, 0.0), "reversal": FittedNaive(5, -0.5)}
_FACTORS = {"zero": "0", "reversal": "-0.5"}

_H1 = " UNION ALL ".join(f"""SELECT symbol, '{k}' AS kind, next_date AS date, next_price AS actual, adj_close * exp({f} * coalesce(log_return, 0)) AS predicted
FROM (SELECT *, lead(date) OVER w AS next_date, lead(adj_close) OVER w AS next_price FROM v_split5 WINDOW w AS (PARTITION BY symbol ORDER BY date))
WHERE split = 'test' AND next_date IS NOT NULL""" for k, f in _FACTORS.items())


@query("h1_overlay", _H1, ["actual", "predicted"])
def h1_overlay(spark, d):
    return forecast.h1_overlay(split5(spark, d), BASELINES)


_STEP = """(SELECT *, CAST(pos - max(CASE WHEN split = 'test' THEN pos END) OVER (PARTITION BY symbol) AS INTEGER) AS step
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM v_split5))"""
_HO = " UNION ALL ".join(f"""SELECT f.symbol, '{k}' AS kind, f.step, f.date, f.adj_close AS actual, a.adj_close * exp(f.step * ({f} * coalesce(a.log_return, 0))) AS forecast
FROM {_STEP} f JOIN {_STEP} a ON a.symbol = f.symbol AND a.step = 0 WHERE f.step BETWEEN 1 AND 5""" for k, f in _FACTORS.items())


@query("h_overlay_history", f"SELECT symbol, date, step, adj_close FROM {_STEP} WHERE step <= 0 AND step > -200", ["adj_close"])
def h_overlay_history(spark, d):
    return forecast.h_overlay_history(split5(spark, d))


@query("h_overlay", _HO, ["actual", "forecast"])
def h_overlay(spark, d):
    return forecast.h_overlay(split5(spark, d), BASELINES, 5)


@query("diagnostics", f"""SELECT *, sum(cum_actual) OVER w AS cumsum_actual, sum(cum_forecast) OVER w AS cumsum_forecast FROM (
  SELECT *, actual - forecast AS residual, ln(actual / first_value(actual) OVER w) AS cum_actual, ln(forecast / first_value(forecast) OVER w) AS cum_forecast
  FROM ({_HO}) WINDOW w AS (PARTITION BY symbol, kind ORDER BY step ROWS UNBOUNDED PRECEDING))
WINDOW w AS (PARTITION BY symbol, kind ORDER BY step ROWS UNBOUNDED PRECEDING)""",
       ["actual", "forecast", "residual", "cum_actual", "cum_forecast", "cumsum_actual", "cumsum_forecast"])
def diagnostics(spark, d):
    return forecast.diagnostics(forecast.h_overlay(split5(spark, d), BASELINES, 5))


_LASTROW = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM v_features5) WHERE rn = 1)"
_PATH = f"""SELECT symbol, CAST(step AS INTEGER) AS step, day AS date, -0.5 * coalesce(log_return, 0) AS log_return, adj_close * exp(step * (-0.5 * coalesce(log_return, 0))) AS price
FROM (SELECT symbol, log_return, adj_close, day, row_number() OVER (PARTITION BY symbol ORDER BY day) AS step FROM (
  SELECT *, date + CAST(i AS INTEGER) AS day FROM {_LASTROW} CROSS JOIN range(1, 20) r(i)) WHERE isodow(day) < 6) WHERE step <= 5"""


def baseline_forecast(spark, d):
    raw = bars(spark, d)
    return forecast.batch_forecast(raw, None, FittedNaive(5, -0.5), 5, limits=False)


@query("baseline_path", _PATH, ["log_return", "price"])
def baseline_path(spark, d):
    return forecast.explode_path(baseline_forecast(spark, d))


@query("forecast_guard", f"""SELECT symbol, date AS last_date, adj_close AS current_price, adj_close * exp(-0.5 * coalesce(log_return, 0)) AS predicted_price FROM {_LASTROW}""",
       ["current_price", "predicted_price"])
def forecast_guard(spark, d):
    return guards.valid_forecasts(baseline_forecast(spark, d)).select("symbol", "last_date", "current_price", "predicted_price")


@query("layered_chart", f"""SELECT symbol, date, adj_close AS price, 'actual' AS series FROM v_price
UNION ALL SELECT symbol, date, price, 'predicted' FROM ({_PATH}) p
UNION ALL SELECT symbol, date, price, 'last' FROM ({_PATH}) p WHERE step = 5""", ["price"])
def layered_chart(spark, d):
    path = forecast.explode_path(baseline_forecast(spark, d))
    return forecast.layered_chart(bars(spark, d), path)


# --- fitted models (rows only) ------------------------------------------------------------------

def fitted_net(df, scope=()):
    """Elastic net for all targets of the table."""
    feats, targets = columns.feature_columns(df), [t for t in T30 if t in df.columns]
    return ElasticNet(horizon=len(targets), scope=scope, alpha=1e-3, l1_ratio=0.2).fit(df.where("split = 'train'"), feats, targets)


@query("elastic_net")
def elastic_net(spark, d):
    """Test errors of one model over all series, beside the zero-return baseline."""
    df = stage(panel30(spark, d), "panel")
    test = df.where("split = 'test'")
    scored = training.evaluate(fitted_net(df), test, T30).select(F.lit("linreg").alias("name"), *ERRORS)
    return training.with_baseline(scored, df)


@query("elastic_net_by_series")
def elastic_net_by_series(spark, d):
    df = stage(panel30(spark, d), "panel")
    return training.evaluate(fitted_net(df, ("symbol",)), df.where("split = 'test'"), T30, ["symbol"])


@query("coefficients")
def coefficients(spark, d):
    df = stage(split5(spark, d), "panel")
    return fitted_net(df, ("symbol",)).coefficients()


@query("bundle_roundtrip")
def bundle_roundtrip(spark, d):
    """Predictions of a model that was saved and loaded."""
    df = stage(split5(spark, d), "panel")
    path = stage_path(spark, "bundle")
    fitted_net(df).save(path)
    model = FittedElasticNet.load(spark, path)
    return training.predict_long(model, df.where("split = 'test'"), T5, KD)


@query("tuning_trials")
def tuning_trials(spark, d):
    df = stage(panel30(spark, d), "panel")
    return tuning.tune_elastic_net(df.where("split = 'train'"), MODEL_INPUTS, T30, ElasticNet(horizon=30), trials=30).trials


@query("tuning_by_series")
def tuning_by_series(spark, d):
    df = stage(panel30(spark, d), "panel")
    net = ElasticNet(horizon=30, scope=("symbol",))
    return tuning.tune_elastic_net(df.where("split = 'train'"), MODEL_INPUTS, T30, net, trials=30).best_table()


@query("experiments")
def experiments(spark, d):
    """Tuned elastic net with and without sentiment, compared."""
    df = features.create_features(features.merged_panel(bars(spark, d), daily(spark, d)), 30)
    pair = [Experiment("linreg", lambda h, s: ElasticNet(h, s), True), Experiment("linreg_wo_sent", lambda h, s: ElasticNet(h, s), False)]
    results = training.run_experiments(df, pair, 30, 42, trials=30)
    tagged = [metrics.tag(r.metrics.withColumn("name", F.lit("linreg")), "sentiment", "with" if r.include_sentiment else "without") for r in results]
    return metrics.improvement(metrics.compare(tagged[0].unionByName(tagged[1]), ["name"], "sentiment", ["with", "without"]), ["name"])


@query("batch_forecast")
def batch_forecast(spark, d):
    df = stage(panel30(spark, d), "panel")
    path = forecast.batch_forecast(bars(spark, d), news(spark, d), fitted_net(df), 30, enrich=True)
    return forecast.explode_path(path)


def fitted_trees(df, horizons=T5):
    part = {s: df.where(F.col("split") == s) for s in ("train", "val")}
    trees = BoostedTrees(horizon=len(horizons), n_estimators=10, max_depth=3, learning_rate=0.1, max_bin=64)
    return trees.fit(part["train"], MODEL_INPUTS, horizons, part["val"])


@query("boosted_trees")
def boosted_trees(spark, d):
    df = stage(split5(spark, d), "panel")
    path = stage_path(spark, "trees-bundle")
    fitted_trees(df).save(path)
    return training.evaluate(FittedTrees.load(spark, path), df.where("split = 'test'"), T5, ["symbol"])


@query("linear_shap")
def linear_shap(spark, d):
    df = stage(panel5(spark, d), "panel")
    test = df.where("split = 'test'")
    return explain.linear_attribution(fitted_net(df), test, explain.background(test, KD), KD)


@query("shap_summary")
def shap_summary(spark, d):
    return explain.summarise(linear_shap(spark, d))


@query("kernel_shap")
def kernel_shap(spark, d):
    """Attributions of the tree models of all horizons for all test rows, background from test rows."""
    df = stage(split5(spark, d), "panel")
    test = df.where("split = 'test'")
    return explain.coalition_attribution(fitted_trees(df), test, explain.background(test, KD), KD)
