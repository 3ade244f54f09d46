import datetime as dt
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapewright.models.base import Experiment
from tapewright.models.boosted_trees import BoostedTrees, FittedTrees, best_round
from tapewright.models.elastic_net import ElasticNet, FittedElasticNet, minimise
from tapewright.models.naive import FittedNaive, Naive
from tapewright.models.spaces import Steps, sample
from tapewright.operators import features, prep, split
from tapewright.operators.columns import feature_columns
from tapewright.plans import explain, forecast, training, tuning
from tapewright.session import stage, stage_path
from tapewright.sources import payload

T3 = ["target_1", "target_2", "target_3"]


@pytest.fixture(scope="module")
def panel(spark):
    """Two series whose next return partly repeats the last one."""
    rng, rows = random.Random(11), []
    for symbol in ("A", "B"):
        price, ret = 100.0, 0.0
        for i in range(260):
            ret = 0.6 * ret + rng.gauss(0, 0.01)
            price *= math.exp(ret)
            rows.append((symbol, dt.date(2020, 1, 1) + dt.timedelta(i), *[price] * 5, 10.0))
    price = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, adj_close double, volume double")
    return price, stage(split.time_series_split(features.create_features(price, 3), horizon=3))


def part(panel, name):
    return panel[1].where(F.col("split") == name)


@pytest.mark.parametrize("alpha, l1", [(1e-3, 0.2), (1e-2, 0.84), (1e-1, 1.0), (1e-5, 0.0), (0.3, 0.5)])
def test_minimiser_meets_the_optimality_conditions(alpha, l1):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 12))
    x[:, 11] = x[:, 0] + x[:, 1]
    y = x[:, 0] * 0.5 - x[:, 5] + rng.normal(size=200)
    x, y = x - x.mean(0), y - y.mean()
    n = len(y)
    w = minimise(x.T @ x, x.T @ y, n, alpha, l1, 2000)
    grad = x.T @ (y - x @ w) / n - alpha * (1 - l1) * w
    gap = np.where(w != 0, np.abs(grad - alpha * l1 * np.sign(w)), np.maximum(np.abs(grad) - alpha * l1, 0))
    assert gap.max() < 1e-8


def test_elastic_net_agrees_with_spark_ml(spark, panel):
    train = part(panel, "train")
    feats = ["log_return", "lag_1", "lag_2", "lag_3"]
    fitted = ElasticNet(alpha=0.01, l1_ratio=0.5).fit(train, feats, T3)
    inputs = prep.Inputs.of(feats)
    fill = prep.fill_values(train, inputs)
    enc = prep.encode(train, inputs, fill, T3)
    std = prep.standardise(enc, inputs, prep.scale_stats(enc, inputs), T3)
    scale = {r["target"]: r for r in prep.target_scale(train, T3).collect()}
    vec = VectorAssembler(inputCols=feats, outputCol="v").transform(std)
    mine = {(r["horizon"], r["feature"]): r["scaled_weight"] for r in fitted.coefficients().collect()}
    for h, t in enumerate(T3, 1):
        data = vec.withColumn("y", prep.scale_target(F.col(t), F.lit(scale[t]["mean"]), F.lit(scale[t]["std"])))
        ref = LinearRegression(featuresCol="v", labelCol="y", regParam=0.01, elasticNetParam=0.5, standardization=False, tol=1e-12, maxIter=1000).fit(data)
        np.testing.assert_allclose([mine[h, f] for f in feats], ref.coefficients.toArray(), atol=1e-6)


def test_predictions_follow_from_the_coefficients(panel):
    test = part(panel, "test")
    feats = feature_columns(panel[1])
    fitted = ElasticNet(alpha=1e-3).fit(part(panel, "train"), feats, T3)
    coef = {(r["horizon"], r["feature"]): r["weight"] for r in fitted.coefficients().collect()}
    row = fitted.transform(test).orderBy("symbol", "date").first()
    want = coef[1, "(intercept)"] + coef[1, f"dow_{row['dow']}"] + coef[1, f"quarter_{row['quarter']}"]
    want += sum(coef[1, f] * row[f] for f in feats if f not in ("dow", "quarter"))
    assert row["pred_1"] == pytest.approx(want, rel=1e-9)


def test_one_model_per_series_equals_separate_fits(panel):
    feats = feature_columns(panel[1])
    train, test = part(panel, "train"), part(panel, "test")
    joint = ElasticNet(scope=("symbol",)).fit(train, feats, T3).transform(test)
    for s in ("A", "B"):
        own = F.col("symbol") == s
        alone = ElasticNet().fit(train.where(own), feats, T3).transform(test.where(own)).orderBy("date").toPandas()
        np.testing.assert_allclose(joint.where(own).orderBy("date").toPandas()[["pred_1", "pred_3"]], alone[["pred_1", "pred_3"]], rtol=1e-6, atol=1e-12)


def test_large_levels_do_not_spoil_the_fit(panel):
    """An input of 10^9 plus a small signal is worth exactly the signal."""
    shift = lambda df: df.withColumn("level", F.col("log_return") * 1000 + F.lit(1e9)).withColumn("signal", F.col("level") - F.lit(1e9))
    train, test = shift(part(panel, "train")), shift(part(panel, "test"))
    a = ElasticNet().fit(train, ["level"], T3).transform(test).orderBy("symbol", "date").toPandas()["pred_1"]
    b = ElasticNet().fit(train, ["signal"], T3).transform(test).orderBy("symbol", "date").toPandas()["pred_1"]
    np.testing.assert_allclose(a, b, rtol=1e-4, atol=1e-8)


def test_bundle_round_trip(spark, panel):
    feats = feature_columns(panel[1])
    model = ElasticNet(scope=("symbol",)).fit(part(panel, "train"), feats, T3)
    path = stage_path(spark, "bundle")
    model.save(path)
    again = FittedElasticNet.load(spark, path)
    test = part(panel, "test")
    assert again.transform(test).orderBy("symbol", "date").collect() == model.transform(test).orderBy("symbol", "date").collect()
    FittedNaive(3, 0.5).save(f"{path}-naive")
    assert FittedNaive.load(spark, f"{path}-naive") == FittedNaive(3, 0.5)


def test_gram_scores_equal_predicted_scores(panel):
    """Tuning never predicts rows; its score must be what prediction would give."""
    feats, train = ["log_return", "lag_1", "lag_2", "dow"], part(panel, "train")
    net = ElasticNet(seed=3)
    fast = tuning.tune_elastic_net(train, feats, T3, net, trials=4)
    slow = tuning.tune(train, feats, T3, net, trials=4)
    a = {(r["trial"], r["fold"]): r["score"] for r in fast.trials.collect()}
    b = {(r["trial"], r["fold"]): r["score"] for r in slow.trials.collect()}
    assert a == pytest.approx(b, rel=1e-8) and len(a) == 4 + 2
    assert fast.best_params() == slow.best_params()
    per = tuning.tune_elastic_net(train, feats, T3, ElasticNet(seed=3, scope=("symbol",)), trials=4)
    assert per.best_table().count() == 2


@pytest.mark.parametrize("scope, folds, gap", [((), 4, 3), (("symbol",), 3, 0)])
def test_fold_grams_impute_by_fold(panel, scope, folds, gap):
    """Folds with gaps and missing values, a late column without any early value: the same scores as fits on copied rows."""
    feats = ["log_return", "lag_1", "lag_2", "dow"]
    gone = F.pmod(F.xxhash64("symbol", "date"), F.lit(4))
    late = F.row_number().over(Window.partitionBy("symbol").orderBy("date")) > 40
    train = part(panel, "train").withColumns({
        "lag_1": F.when(gone != 0, F.col("lag_1")), "lag_2": F.when(late, F.col("lag_2")), "dow": F.when(gone != 1, F.col("dow")),
    })
    net = ElasticNet(seed=3, scope=scope)
    fast = tuning.tune_elastic_net(train, feats, T3, net, trials=3, folds=folds, gap=gap)
    assert fast.trials.groupBy("trial", "fold").count().count() == 3 + folds - 1
    if not scope:
        slow = tuning.tune(train, feats, T3, net, trials=3, folds=folds, gap=gap)
        a = {(r["trial"], r["fold"]): r["score"] for r in fast.trials.collect()}
        assert a == pytest.approx({(r["trial"], r["fold"]): r["score"] for r in slow.trials.collect()}, rel=1e-8)
    else:
        for symbol in ("A", "B"):
            one = train.where(F.col("symbol") == symbol)
            if one.isEmpty():
                continue
            slow = tuning.tune(one, feats, T3, ElasticNet(seed=3), trials=3, folds=folds, gap=gap)
            a = {(r["trial"], r["fold"]): r["score"] for r in fast.trials.where(F.col("symbol") == symbol).collect()}
            assert a == pytest.approx({(r["trial"], r["fold"]): r["score"] for r in slow.trials.collect()}, rel=1e-8)


def test_promotion_does_not_depend_on_the_order_of_completion():
    rng = random.Random(3)
    for trials in (1, 2, 7, 30):
        scores = {t: rng.choice([0.1, 0.2, rng.random(), math.nan]) for t in range(trials)}
        keep = math.ceil(trials / tuning.REDUCTION)
        want = set(sorted(scores, key=lambda t: (math.isnan(scores[t]), scores[t], t))[:keep])
        for _ in range(20):
            order, promoted, early = rng.sample(range(trials), trials), set(), 0
            for n in range(1, trials + 1):
                promoted |= tuning.certain({t: scores[t] for t in order[:n]}, trials, keep)
                assert promoted <= want
                early += n < trials and bool(promoted)
            assert promoted == want
            assert early or keep == trials or trials < 7 or want == {order[-1]}


class FewTrees(BoostedTrees):
    """Trees with a small search space."""

    @classmethod
    def search_space(cls):
        return {"n_estimators": Steps(4, 12, 4), "max_depth": Steps(1, 3), "early_stopping_rounds": 3, "objective": "reg:squarederror"}


def test_trees_through_the_experiment_runner(spark, panel):
    """All horizons tuned, fitted, saved and scored beside the baseline."""
    trees = Experiment("xgboost", lambda h, s: FewTrees(horizon=h, seed=s, subsample=1.0, colsample_bytree=1.0, learning_rate=0.3), True)
    df = features.create_features(panel[0], 3)
    result = training.run_experiments(df, [trees], 3, 42, trials=4, out=stage_path(spark, "tree-runs"))[0]
    assert result.tuning.trials.count() == 4 + 2 and set(result.params) >= {"n_estimators", "max_depth"}
    assert sum(r["key"] == "max_depth" for r in result.tuning.params_table().collect()) == 4
    assert FittedTrees.load(spark, result.paths["model"]).horizon == 3
    table = {r["name"]: r["rmse"] for r in training.with_baseline(result.metrics, training.prepare(df, 3)).collect()}
    assert set(table) == {"xgboost", "zero_return"} and 0 < table["xgboost"] < 1.2 * table["zero_return"]


def test_folds_without_copies(panel):
    """Ten folds: one row per input row, and no operator that copies rows."""
    rows = part(panel, "train")
    placed = split.fold_states(rows, 10, 2)
    assert placed.count() == rows.count()
    copied = split.expanding_folds(rows, 10, 2).groupBy("fold", "role").count().collect()
    for r in copied:
        letter = {"train": split.TRAIN, "val": split.VAL}[r["role"]]
        assert placed.where(split.in_fold(r["fold"], letter)).count() == r["count"]


def test_sampling_is_seeded_and_in_range():
    space = BoostedTrees.search_space()
    a = sample(space, 50, 1)
    assert a == sample(space, 50, 1) != sample(space, 50, 2)
    for p in a:
        assert 400 <= p["n_estimators"] <= 1200 and 0.02 <= p["learning_rate"] <= 0.1
        lossguide = p["grow_policy"] == "lossguide"
        assert (p["max_depth"] == 0) == lossguide and (p["max_leaves"] > 0) == lossguide
    for p in sample(ElasticNet.search_space(), 50, 1):
        assert 1e-5 <= p["alpha"] <= 1e-2 and p["max_iter"] in range(1000, 4001, 500)


def test_trees_learn_save_and_explain(spark, panel):
    feats = ["log_return", "lag_1", "dow"]
    trees = BoostedTrees(n_estimators=8, max_depth=3, learning_rate=0.3, subsample=1.0, colsample_bytree=1.0, max_bin=32)
    model = trees.fit(part(panel, "train"), feats, T3[:1], part(panel, "val"))
    test = part(panel, "test")
    zero = training.evaluate(FittedNaive(1), test, T3[:1]).first()["rmse"]
    assert training.evaluate(model, test, T3[:1]).first()["rmse"] < zero
    path = stage_path(spark, "trees")
    model.save(path)
    loaded = FittedTrees.load(spark, path)
    want = {(r["symbol"], r["date"]): r["pred_1"] for r in model.transform(test).collect()}
    assert {(r["symbol"], r["date"]): r["pred_1"] for r in loaded.transform(test).collect()} == want
    few = test.where("date < '2020-08-28'")
    phi = explain.coalition_attribution(model, few, explain.background(test, ["symbol", "date"]), ["symbol", "date"])
    sums = phi.groupBy("symbol", "date").agg((F.sum("phi") + F.first("base")).alias("p")).collect()
    assert sums
    for r in sums:
        assert r["p"] == pytest.approx(want[r["symbol"], r["date"]], abs=1e-9)
    assert trees.with_params(reg_alpha=0.5, max_depth=0).ignored() == {"reg_alpha": 0.5, "max_depth": 0}


def test_linear_attributions_add_up(panel):
    feats, test = feature_columns(panel[1]), part(panel, "test")
    model = ElasticNet(alpha=1e-3).fit(part(panel, "train"), feats, T3)
    key = ["symbol", "date"]
    phi = explain.linear_attribution(model, test, explain.background(test, key), key)
    sums = phi.groupBy(*key, "horizon").agg((F.sum("phi") + F.first("base")).alias("p"))
    both = sums.where("horizon = 2").join(model.transform(test), key).select("p", "pred_2").collect()
    assert len(both) == test.count()
    for r in both:
        assert r["p"] == pytest.approx(r["pred_2"], abs=1e-12)
    top = explain.summarise(phi).where("horizon = 1 AND rank = 1").first()
    assert top["feature"] == "log_return"


def shapley(value, p):
    """By definition: the mean over all orders of what an input adds."""
    out = np.zeros(p)
    for order in itertools.permutations(range(p)):
        z = np.zeros(p)
        for j in order:
            before = value(z)
            z[j] = 1
            out[j] += value(z) - before
    return out / math.factorial(p)


@pytest.mark.parametrize("p", [1, 2, 3, 5])
def test_all_coalitions_give_shapley_values(p):
    rng = np.random.default_rng(p)
    table = {z: rng.normal() for z in itertools.product((0, 1), repeat=p)}
    masks, solver = explain.coalition_design(p, 64)
    got = solver @ [table[tuple(m.astype(int))] for m in masks]
    np.testing.assert_allclose(got, shapley(lambda z: table[tuple(z.astype(int))], p), atol=1e-10)


def test_a_sampled_design_is_exact_for_additive_models():
    rng = np.random.default_rng(4)
    masks, solver = explain.coalition_design(12, 60)
    assert len(masks) <= 62 and len({tuple(m) for m in masks}) == len(masks)
    assert {tuple(1 - m) for m in masks} == {tuple(m) for m in masks}
    w = rng.normal(size=12)
    np.testing.assert_allclose(solver @ (masks @ w + 3), w, atol=1e-9)


def test_coalitions_equal_linear_attributions(panel):
    """Several inputs, one categorical: the levels of an input add up to its attribution."""
    test, key = part(panel, "test"), ["symbol", "date"]
    model = ElasticNet(alpha=1e-3).fit(part(panel, "train"), ["log_return", "lag_1", "lag_2", "dow"], T3)
    few = test.where("date < '2020-09-10'")
    by = explain.coalition_attribution(model, few, test, key, size=20)
    ground = test.orderBy(*key).limit(20)
    linear = explain.linear_attribution(model, few, ground, key).withColumn("feature", F.regexp_replace("feature", "^dow_.*", "dow"))
    linear = linear.groupBy(*key, "horizon", "feature").agg(F.sum("phi").alias("want"), F.first("base").alias("want_base"))
    both = by.join(linear, [*key, "horizon", "feature"]).collect()
    assert len(both) == few.count() * 3 * 4
    for r in both:
        assert r["phi"] == pytest.approx(r["want"], abs=1e-12) and r["base"] == pytest.approx(r["want_base"], abs=1e-12)


def test_early_stopping_by_rounds(spark, panel):
    assert best_round([5, 4, 3, 3.5, 3.2, 2.9, 1.0], 2) == 3
    assert best_round([5, 4, 3, 3.5, 3.2, 2.9, 1.0], 4) == 7 and best_round([1.0], 5) == 1
    feats = ["log_return", "lag_1"]
    trees = BoostedTrees(n_estimators=25, max_depth=4, learning_rate=0.9, subsample=1.0, colsample_bytree=1.0, early_stopping_rounds=3)
    train, val = part(panel, "train"), part(panel, "val")
    cut = trees.fit(train, feats, T3[:1], val)
    whole = trees.with_params(early_stopping_rounds=0).fit(train, feats, T3[:1], val)
    kept = cut.models[0].getNumTrees
    assert kept < 25 == whole.models[0].getNumTrees
    short = trees.with_params(n_estimators=kept).fit(train, feats, T3[:1])
    a, b = (sorted(r["pred_1"] for r in m.transform(val).collect()) for m in (cut, short))
    assert a == pytest.approx(b, abs=1e-12)
    path = stage_path(spark, "cut")
    cut.save(path)
    assert FittedTrees.load(spark, path).models[0].getNumTrees == kept


def test_experiment_run_leaves_its_tables(spark, panel):
    exps = [Experiment("linreg", lambda h, s: ElasticNet(h, s), True), Experiment("naive", lambda h, s: Naive(h), False)]
    df = features.create_features(panel[0], 3)
    out = stage_path(spark, "runs")
    res = training.run_experiments(df, exps, 3, 42, trials=3, out=out)
    assert [r.kind for r in res] == ["linreg", "naive"]
    first = res[0]
    assert set(first.paths) == {"X_test", "params", "trials", "model", "predictions", "metrics"}
    rows = spark.read.option("header", True).csv(first.paths["metrics"]).collect()
    assert rows[0]["name"] == "linreg" and float(rows[0]["rmse"]) > 0
    assert first.last_path.count() == 2 * 3
    table = training.with_baseline(first.metrics, training.prepare(df, 3)).collect()
    got = {r["name"]: r["rmse"] for r in table}
    assert got["linreg"] < got["zero_return"] == pytest.approx(res[1].metrics.first()["rmse"])
    with pytest.raises(ValueError):
        training.prepare(df, 5)


def request(spark, n, start, stop, news=None):
    price = []
    day = dt.date(2025, 4, 2)
    for i in range(n):
        p = start + (stop - start) * i / (n - 1)
        price.append({"date": day.isoformat(), "open": p, "high": p, "low": p, "close": p, "adj_close": p, "volume": 1})
        day += dt.timedelta(3 if day.weekday() == 4 else 1)
    body = json.dumps({"symbol": "DJIA", "price": price, "news": news})
    return payload.parse_requests(spark.createDataFrame([(body,)], "body string"))


def test_forecast_from_a_request(spark):
    req = request(spark, 60, 100.0, 150.0)
    price = payload.request_prices(req)
    again = price.where("date > '2025-05-01'").withColumn("seq", F.col("seq") + 1000).withColumn("adj_close", F.col("adj_close") + 1)
    out = forecast.batch_forecast(price.unionByName(again), None, FittedNaive(30, 1.0), 45).first()
    last, before = 151.0, 151.0 - 50 / 59
    lr = math.log(last / before)
    assert out["horizon"] == 30 and out["current_price"] == pytest.approx(last) and out["log_return"] == pytest.approx(lr)
    assert out["predicted_price"] == pytest.approx(last * math.exp(lr)) == out["predicted_price_path"][0]
    assert out["predicted_price_path"][29] == pytest.approx(last * math.exp(30 * lr))
    assert len(out["predicted_dates"]) == 30 and all(d.weekday() < 5 for d in out["predicted_dates"])
    assert out["predicted_dates"][0] > out["last_date"]
    other = forecast.batch_forecast(payload.request_prices(request(spark, 60, 120.0, 170.0)), None, FittedNaive(30, 1.0)).first()
    assert other["log_return"] != out["log_return"]


def test_forecast_uses_news_and_reports_violations(spark, panel):
    feats = ["log_return", "lag_1", "pos_minus_neg"]
    price = payload.request_prices(request(spark, 60, 100.0, 150.0))
    last = price.agg(F.max("date")).first()[0].isoformat()
    news = payload.request_news(request(spark, 60, 1.0, 2.0, [{"date": last, "headline": "great profit"}]))
    train = part(panel, "train").withColumn("pos_minus_neg", F.col("target_1") * 10)
    model = ElasticNet(alpha=1e-4).fit(train, feats, T3)
    with_news = forecast.batch_forecast(price, news, model, 3, enrich=True).first()
    without = forecast.batch_forecast(price, None, model, 3).first()
    assert with_news["log_return"] > without["log_return"]
    assert forecast.request_violations(price, news).count() == 0
    wide = price.withColumn("date", F.date_add("date", F.col("seq").cast("int") * 40))
    assert forecast.batch_forecast(wide, None, model, 3, limits=True).count() == 0
    assert forecast.batch_forecast(wide, None, model, 3).count() == 1
    assert [r["reason"] for r in forecast.request_violations(wide, None).collect()] == ["span_too_long"]


def test_overlays_and_diagnostics(panel):
    full, models = panel[1], {"zero": FittedNaive(3), "last": FittedNaive(3, 1.0)}
    over = forecast.h_overlay(full, models, 3)
    rows = over.where("symbol = 'A' AND kind = 'zero'").orderBy("step").collect()
    anchor = full.where("symbol = 'A' AND split = 'test'").orderBy(F.col("date").desc()).first()
    assert [r["forecast"] for r in rows] == [anchor["adj_close"]] * 3 and len(rows) == 3
    diag = forecast.diagnostics(over).where("symbol = 'A' AND kind = 'last'").orderBy("step").collect()
    assert diag[0]["cum_actual"] == 0.0
    assert diag[2]["cumsum_actual"] == pytest.approx(diag[1]["cum_actual"] + diag[2]["cum_actual"])
    assert diag[1]["residual"] == pytest.approx(diag[1]["actual"] - diag[1]["forecast"])
    h1 = forecast.h1_overlay(full, models).where("symbol = 'B' AND kind = 'zero'")
    assert h1.count() == full.where("symbol = 'B' AND split = 'test'").count()
    hist = forecast.h_overlay_history(full, 20).where("symbol = 'A'")
    assert hist.count() == 20 and hist.agg(F.max("date")).first()[0] == anchor["date"]


# --- hard inputs ---------------------------------------------------------------------------

def test_levels_of_targets_do_not_change_scores(spark, panel):
    train = part(panel, "train")
    raised = train.withColumns({t: F.col(t) + 1e8 for t in T3})
    one, other = (tuning.tune_elastic_net(df, ["log_return", "lag_1"], T3, ElasticNet(seed=1), trials=6, metric=m).trials.orderBy("trial", "fold").collect()
                  for df, m in ((train, "r2"), (raised, "r2")))
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in other], abs=1e-5)
    fits = [ElasticNet(alpha=1e-4).fit(df, ["log_return"], T3).table.first() for df in (train, raised)]
    assert np.array(fits[1]["bias"]) - 1e8 == pytest.approx(np.array(fits[0]["bias"]), abs=1e-5)


def test_unseen_and_null_series_keep_their_rows(spark, panel):
    train = part(panel, "train")
    named = train.withColumn("symbol", F.lit(None).cast("string")).unionByName(train.withColumn("symbol", F.lit("A")))
    model = ElasticNet(alpha=1e-4, scope=("symbol",)).fit(named, ["log_return"], T3)
    assert {r["symbol"] for r in model.table.collect()} == {None, "A"}
    asked = named.unionByName(train.withColumn("symbol", F.lit("new")))
    out = model.transform(asked)
    assert out.count() == asked.count()
    assert {r["symbol"]: r["n"] > 0 for r in out.groupBy("symbol").agg(F.count("pred_1").alias("n")).collect()} == {None: True, "A": True, "new": False}


def test_attributions_are_complete(spark, panel):
    train = part(panel, "train")
    model = ElasticNet(alpha=10.0, l1_ratio=1.0).fit(train, ["log_return", "lag_1"], T3)  # all weights are 0
    phi = explain.linear_attribution(model, train, train, ["date"])
    assert phi.count() == train.count() * 2 * 3 and phi.agg(F.max(F.abs("phi"))).first()[0] == 0.0


def test_forecast_is_not_cut_unless_asked(spark, panel):
    """More than 2,000 rows and 5 years, a long horizon and many headlines: every series comes back."""
    rows = spark.range(2600).selectExpr("'L' symbol", "date_add(date '2000-01-03', cast(id as int)) date", "100 + id % 7 adj_close")
    price = rows.selectExpr("symbol", "date", *[f"cast(adj_close as double) {c}" for c in ("open", "high", "low", "close", "adj_close")], "1.0D volume")
    out = forecast.batch_forecast(price, None, FittedNaive(45, 1.0), 45).collect()
    assert len(out) == 1 and out[0]["horizon"] == 45 and len(out[0]["log_return_path"]) == 45
    assert forecast.batch_forecast(price, None, FittedNaive(45, 1.0), 45, limits=True).count() == 0
    with pytest.raises(ValueError, match="not unique"):
        forecast.batch_forecast(price.unionByName(price.limit(1)), None, FittedNaive(3, 1.0), 3)
