import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewright.operators import metrics, prep, quantiles, stats
from tapewright.operators.gram import gram_table, unpack
from tapewright.operators.quantiles import exact_quantiles, sketched_quantiles
from tapewright.session import stage


@pytest.fixture(scope="module")
def values():
    rng = random.Random(3)
    return [rng.gauss(0, 1) for _ in range(900)] + [0.5] * 450 + [None] * 40


@pytest.mark.parametrize("buckets", [4, 64])
def test_quantiles_are_exact_by_bracketing(spark, values, buckets):
    """A third of the rows share one value; tiny limits force many rounds."""
    df = spark.createDataFrame([(v, float(i % 7), None) for i, v in enumerate(values)], "a double, b double, c double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs, small=10, buckets=buckets)
    np.testing.assert_allclose(got["a"], np.quantile([v for v in values if v is not None], probs), rtol=1e-13)
    np.testing.assert_allclose(got["b"], np.quantile([float(i % 7) for i in range(len(values))], probs), rtol=1e-13)
    assert got["c"] == [None] * len(probs)
    small = exact_quantiles(df.unionByName(df.limit(1).withColumn("a", F.lit(float("nan")))), ["a", "b"], probs)
    np.testing.assert_allclose(small["a"], got["a"], rtol=1e-13)


def frame(spark, xs, symbol="A"):
    return spark.createDataFrame([(symbol, dt.date(2020, 1, 1) + dt.timedelta(i), x) for i, x in enumerate(xs)], "symbol string, date date, log_return double")


def test_describe_matches_pandas(spark, values):
    row = stats.describe(frame(spark, values), ["log_return"]).first()
    want = pd.Series(values, dtype=float).describe()
    assert row["count"] == want["count"]
    np.testing.assert_allclose([row[c] for c in ("mean", "std", "min", "q25", "q50", "q75", "max")],
                               [want[c] for c in ("mean", "std", "min", "25%", "50%", "75%", "max")], rtol=1e-12)


def test_histogram_matches_numpy(spark, values):
    known = [v for v in values if v is not None]
    got = stats.histogram(frame(spark, values)).orderBy("bin").collect()
    counts, edges = np.histogram(known, bins=50)
    assert [r["count"] for r in got] == counts.tolist()
    np.testing.assert_allclose([r["bin_left"] for r in got], edges[:-1], atol=1e-12)
    flat = stats.histogram(frame(spark, [2.0, 2.0, 2.0]), bins=4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == np.histogram([2.0] * 3, bins=4)[0].tolist()
    log = stats.histogram(frame(spark, [1.0, 10.0, 100.0, -5.0]), bins=2, log_scale=True).orderBy("bin").collect()
    assert [r["count"] for r in log] == [1, 2] and log[1]["bin_right"] == pytest.approx(100.0)


def test_density_matches_definition(spark):
    xs = [0.1, 0.4, 0.45, 0.9, -0.3]
    got = stats.density(frame(spark, xs), points=11, bins=10).orderBy("point").collect()
    bw = np.std(xs, ddof=1) * len(xs) ** -0.2
    grid = np.linspace(min(xs), max(xs), 11)
    want = [np.mean(np.exp(-0.5 * ((g - np.array(xs)) / bw) ** 2)) / (bw * math.sqrt(2 * math.pi)) for g in grid]
    np.testing.assert_allclose([r["density"] for r in got], want, rtol=1e-12)
    np.testing.assert_allclose([r["scaled"] for r in got], np.array(want) * 5 * 1.2 / 10, rtol=1e-12)


def test_autocorrelation_matches_definition(spark):
    rng = random.Random(5)
    xs = [rng.random() for _ in range(60)]
    got = stats.autocorrelation(frame(spark, xs), lags=5).orderBy("lag").collect()
    d = np.array(xs) - np.mean(xs)
    want = [float((d[k:] * d[:-k]).sum() / (d * d).sum()) for k in range(1, 6)]
    np.testing.assert_allclose([r["acf"] for r in got], want, rtol=1e-10)
    assert got[0]["band"] == pytest.approx(stats.Z95 / math.sqrt(60))
    assert got[2]["band"] == pytest.approx(stats.Z95 * math.sqrt((1 + 2 * (want[0] ** 2 + want[1] ** 2)) / 60))
    assert stats.autocorrelation(frame(spark, [1.0, 1.0, 1.0]), lags=1).first()["acf"] is None


def test_correlation_uses_pairs_where_both_are_known(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0, 7.0], "b": [2.0, None, 1.0, 3.0, 9.0], "c": [5.0, 4.0, 3.0, 2.0, 2.5]})
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)]
    got = {(r["a"], r["b"]): r["corr"] for r in stats.correlation(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    want = pdf.corr()
    for (i, j), v in got.items():
        assert v == pytest.approx(want.loc[i, j])


def pairs(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "y_true double, y_pred double")


def test_metrics_by_hand(spark):
    r = metrics.score(pairs(spark, [1.0, 2.0, 4.0], [1.0, 3.0, 2.0])).first()
    assert r["mae"] == pytest.approx(1.0) and r["mse"] == pytest.approx(5 / 3) and r["rmse"] == pytest.approx(math.sqrt(5 / 3))
    assert r["smape"] == pytest.approx((0 + 2 / 5 + 4 / 6) / 3) and r["r2"] == pytest.approx(1 - 5 / (14 / 3))


def test_r2_of_constant_truth(spark):
    assert metrics.score(pairs(spark, [2.0, 2.0], [2.0, 2.0])).first()["r2"] == 1.0
    assert metrics.score(pairs(spark, [2.0, 2.0], [2.0, 3.0])).first()["r2"] == 0.0


def test_shape_mismatch(spark):
    with pytest.raises(ValueError):
        metrics.paired(spark.range(1), [], ["a", "b"], ["p"])


def test_mase(spark):
    hist = frame(spark, [1.0, 3.0, 2.0]).unionByName(frame(spark, [5.0], "B"))
    truth = pairs(spark, [1.0, 2.0], [2.0, 2.0])
    both = truth.withColumn("symbol", F.lit("A")).unionByName(truth.withColumn("symbol", F.lit("B")))
    got = {r["symbol"]: r["mase"] for r in metrics.mase(both, hist, "log_return").collect()}
    assert got["A"] == pytest.approx(0.5 / 1.5) and got["B"] is None
    flat = metrics.in_sample_scale(frame(spark, [1.0, 1.0]), "log_return").first()
    assert flat["scale"] == 1e-8


def test_comparison_and_improvement(spark):
    rows = [("m", "with", 1.0, 1.0, 1.0, 1.0, 0.3), ("m", "without", 1.5, 2.0, 1.0, 0.5, 0.1)]
    df = spark.createDataFrame(rows, "name string, sentiment string, mae double, mse double, rmse double, smape double, r2 double")
    row = metrics.improvement(metrics.compare(df, ["name"], "sentiment", ["with", "without"]), ["name"]).first()
    assert (row["mae_impr"], row["mse_impr"], row["smape_impr"], row["r2_impr"]) == (0.5, 1.0, -0.5, 0.2)


def test_preparation_statistics(spark):
    rows = [(0.01, 55.0, 1, 0), (0.02, 60.0, 2, 1), (None, 58.0, 1, 2), (0.06, 58.0, None, 2)]
    df = spark.createDataFrame(rows, "log_return double, rsi double, quarter int, dow int")
    inputs = prep.Inputs.of(["log_return", "rsi"], ["dow", "quarter"])
    got = {r["feature"]: r for r in prep.prep_stats(df, inputs).collect()}
    filled = [0.01, 0.02, 0.02, 0.06]
    assert got["log_return"]["median"] == pytest.approx(0.02)
    assert got["log_return"]["mean"] == pytest.approx(np.mean(filled)) and got["log_return"]["std"] == pytest.approx(np.std(filled))
    assert got["quarter"]["median"] == 1.0 and got["dow"]["median"] == 2.0
    fill = prep.fill_values(df, inputs)
    enc = prep.encode(df, inputs, fill, [])
    out = prep.standardise(enc, inputs, prep.scale_stats(enc, inputs), [])
    z = out.toPandas()
    np.testing.assert_allclose(z[["log_return", "rsi"]].mean(), 0, atol=1e-12)
    np.testing.assert_allclose(z[["log_return", "rsi"]].std(ddof=0), 1)
    assert z["quarter_1"].tolist() == [1.0, 0.0, 1.0, 1.0]
    unseen = spark.createDataFrame([(None, 1.0, 9, 6)], df.schema)
    row = prep.encode(unseen, inputs, fill, []).first()
    assert row["log_return"] == 0.02 and sum(row[f"quarter_{q}"] for q in (1, 2, 3, 4)) == 0.0


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None)], "flat double, empty double")
    inputs = prep.Inputs.of(["flat", "empty"])
    fill = prep.fill_values(df, inputs)
    assert fill.medians == (1.0, None)
    row = prep.scale_stats(prep.encode(df, inputs, fill, []), inputs).first()
    assert row["stds"] == [1.0, 1.0]


def test_target_scaling_round_trip(spark):
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.2), (3.0, 0.3)], "t1 double, t2 double")
    scale = {r["target"]: r for r in prep.target_scale(df, ["t1", "t2"]).collect()}
    for t in ("t1", "t2"):
        m, s = F.lit(scale[t]["mean"]), F.lit(scale[t]["std"])
        scaled = df.select(prep.scale_target(F.col(t), m, s).alias("z"), t)
        assert [r[0] for r in scaled.select(F.round("z", 6)).collect()] == [-1.224745, 0.0, 1.224745]
        back = scaled.select(prep.unscale_target(F.col("z"), m, s)).collect()
        np.testing.assert_allclose([r[0] for r in back], [r[t] for r in df.collect()])


def test_gram_is_independent_of_partitioning(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 3))
    rows = [("hot" if i % 3 else f"s{i % 9}", *map(float, r)) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "symbol string, x1 double, x2 double, y double").repartition(7)
    got = {r["symbol"]: unpack(r["gram"], 4) for r in gram_table(df, ["symbol"], [F.col("x1"), F.col("x2")], [F.col("y")]).collect()}
    for s in {r[0] for r in rows}:
        z = np.array([[1.0, *r[1:]] for r in rows if r[0] == s])
        np.testing.assert_allclose(got[s], z.T @ z, rtol=1e-12)
    total = unpack(gram_table(df, [], [F.col("x1"), F.col("x2")], [F.col("y")]).first()["gram"], 4)
    np.testing.assert_allclose(total, sum(got.values()), rtol=1e-12)


@pytest.mark.parametrize("small", [20, 10_000])
def test_quantiles_of_infinite_and_far_values(spark, small):
    values = [float("inf")] * 7 + [float("-inf")] * 5 + [1e308, -1e308, 5e-324, 0.0] + [math.exp(i / 3) for i in range(-900, 900)] + [1.0 + i * 1e-15 for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 0.99, 1.0]
    got = exact_quantiles(df, ["a"], probs, small=small, buckets=16)["a"]
    ordered = sorted(values)
    for p, g in zip(probs, got, strict=True):
        at = p * (len(ordered) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert g == (low if low == high else pytest.approx(low + (high - low) * (at - math.floor(at))))


@pytest.mark.parametrize("small, size", [(200_000, 4096), (5, 8)])
def test_sketched_quantiles_by_series(spark, small, size):
    """A hot series, heavy tails, a million equal values; tiny sketches and buffers force every round."""
    probs = [0.9, 0.0, 0.25, 0.5, 1.0, 0.999]
    rng = np.random.default_rng(8)
    data = {"hot": np.exp(rng.standard_normal(3000) * 9), "s": rng.integers(0, 4, 500).astype(float), "one": np.array([7.0]),
            "ends": np.array([-np.inf] * 30 + [np.inf] * 50 + list(rng.standard_normal(100)))}
    rows = [(k, float(v), None if i % 3 else float(-v)) for k, vs in data.items() for i, v in enumerate(vs)] + [("none", None, None), ("s", float("nan"), None)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double").repartition(6)
    got = {(r.symbol, r.column): (r.n, r.q) for r in sketched_quantiles(df, ["a", "b"], probs, ["symbol"], small, 4, size).collect()}
    for k, vs in data.items():
        for column, known in (("a", vs), ("b", -vs[::3])):
            n, q = got.pop((k, column))
            assert n == len(known)
            ordered = np.sort(known)
            for p, g in zip(probs, q, strict=True):
                at = p * (len(ordered) - 1)
                low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
                assert g == (low if low == high else pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-12))
    assert not got


def test_quantiles_of_a_million_equal_values(spark):
    df = spark.range(1_200_000).select(F.when(F.col("id") < 1_000_000, 5.0).otherwise(F.col("id") / 3).alias("a"))
    assert exact_quantiles(df, ["a"], [0.0, 0.1, 0.5, 1.0], small=1000)["a"] == [5.0, 5.0, 5.0, pytest.approx(1_199_999 / 3)]


def test_quantiles_of_few_values_between_brackets(spark):
    """Rows between two brackets count as below the upper one: all the ones lie in none."""
    df = spark.range(110_000).select((F.col("id") % 11).cast("double").alias("a"))
    (row,) = sketched_quantiles(df, ["a"], [0.01, 0.27], small=1000).collect()
    assert (row["n"], row["q"]) == (110_000, [0.0, 2.0])


def test_quantiles_read_the_rows_twice(spark, monkeypatch):
    """One round of brackets is enough, and only the values inside are kept."""
    staged = {}

    def kept(df, name):
        staged.setdefault(name, []).append(stage(df, name))
        return staged[name][-1]

    monkeypatch.setattr(quantiles, "stage", kept)
    n, probs = 200_000, [0.01, 0.5, 0.999]
    df = spark.range(n).select(F.col("id").alias("b"), (-F.col("id") / 3).alias("c"))
    got = {r["column"]: r["q"] for r in sketched_quantiles(df, ["b", "c"], probs, small=100, splitters=16).collect()}
    assert got["b"] == pytest.approx([p * (n - 1) for p in probs], rel=1e-12)
    assert got["c"] == pytest.approx([-(1 - p) * (n - 1) / 3 for p in probs], rel=1e-12)
    assert len(staged["brackets"]) == len(staged["cells"]) == 1
    assert staged["cells"][0].count() < 0.06 * n


def test_correlations_of_pairwise_complete_rows(spark):
    """Many columns with gaps, large levels, a constant and an empty column, one table of cross products."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12))
    x[:, 3] += 1e9
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 10], x[:, 11] = 7.1, np.nan
    cols = [f"c{i}" for i in range(12)]
    rows = [("A" if i % 3 else "B", *[None if np.isnan(v) and i % 2 else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
    frame = pd.DataFrame(x, columns=cols)
    for keys, parts in (([], {(): frame}), (["symbol"], {(s,): frame[[("A" if i % 3 else "B") == s for i in range(400)]] for s in "AB"})):
        got = stats.correlation(df, cols, keys).collect()
        assert len(got) == 66 * len(parts)
        for r in got:
            want = parts[tuple(r[k] for k in keys)].corr(min_periods=2).loc[r["a"], r["b"]]
            if "c10" in (r["a"], r["b"]) or "c11" in (r["a"], r["b"]):
                assert r["corr"] is None
            else:
                assert r["corr"] == pytest.approx(want, abs=1e-6 if "c3" in (r["a"], r["b"]) else 1e-10)


def test_density_by_cell_moments(spark):
    rng = np.random.default_rng(7)
    data = {"A": np.concatenate([rng.standard_normal(700), [40.0, -25.0]]), "B": np.repeat([1.0, 2.0, 5.0], 50), "flat": np.ones(5)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "symbol string, log_return double")
    got = stats.density(df).orderBy("symbol", "point").toPandas()
    assert sorted(set(got.symbol)) == ["A", "B"]
    for k in "AB":
        v, part = data[k], got[got.symbol == k]
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((part.x.to_numpy()[:, None] - v) / h) ** 2).sum(1) / len(v) / h / math.sqrt(2 * math.pi)
        assert len(part) == 200
        np.testing.assert_allclose(part.density, want, atol=1e-11 / h)
