import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapewright.operators import enrich, features, joins, sentiment, series
from tapewright.session import stage_path
from tapewright.sources import files, history, payload

NEWS = "symbol string, date date, seq long, headline string"


def news(spark, rows):
    return spark.createDataFrame([("A", dt.date.fromisoformat(d), i, h) for i, (d, h) in enumerate(rows)], NEWS)


def test_scores_are_probabilities_and_have_the_right_sign(spark):
    rows = [("2024-01-01", "Profit gain, a strong record"), ("2024-01-01", "lawsuit and fraud scandal"), ("2024-01-01", None), ("2024-01-01", "Tuesday")]
    got = sentiment.score_inline(news(spark, rows)).orderBy("seq").collect()
    for r in got:
        assert r["neu"] + r["pos"] + r["neg"] == pytest.approx(1.0) and len(r["emb"]) == 17
    assert got[0]["pos_minus_neg"] > 0.3 > -0.3 > got[1]["pos_minus_neg"]
    assert got[2]["pos_minus_neg"] == 0.0 == got[3]["pos_minus_neg"]


def test_daily_aggregate_values(spark):
    rows = [("2025-01-01", "A", 0.8, 0.1, 0.1, 0.7, 0.1, 0.4), ("2025-01-01", "B", 0.7, 0.1, 0.2, 0.5, 0.2, 0.5), ("2025-01-02", "C", 0.1, 0.1, 0.9, -0.8, 0.3, 0.6)]
    df = spark.createDataFrame(rows, "date string, headline string, pos double, neu double, neg double, pos_minus_neg double, emb_0 double, emb_1 double")
    day = sentiment.aggregate_daily(df.withColumn("symbol", F.lit("A"))).orderBy("date").first()
    want = dict(pos=0.75, neu=0.1, neg=0.15, pos_minus_neg=0.6, emb_0=0.15, emb_1=0.45, headline_count=2)
    for k, v in want.items():
        assert day[k] == pytest.approx(v)


def test_daily_aggregate_fills_unscored_days_with_zero(spark):
    df = news(spark, [("2024-01-01", "x")]).selectExpr("*", *[f"CAST(NULL AS DOUBLE) AS {c}" for c in ("pos", "neu", "neg", "pos_minus_neg")])
    row = sentiment.aggregate_daily(df).first()
    assert (row["pos"], row["headline_count"]) == (0.0, 1)


def test_cache_scores_each_text_once(spark):
    df = news(spark, [("2024-01-01", "gain"), ("2024-01-02", "gain"), ("2024-01-02", "loss"), ("2024-01-03", None)])
    cache = sentiment.ScoreCache(spark, stage_path(spark, "cache"))
    assert cache.misses(df).count() == 3
    first = sentiment.score_cached(df, cache, sentiment.LexiconScorer(), rows_per_task=1)
    inline = {r["seq"]: r["pos"] for r in sentiment.score_inline(df).collect()}
    assert {r["seq"]: r["pos"] for r in first.collect()} == pytest.approx(inline)
    assert cache.misses(df).count() == 0
    cache.fill(df, sentiment.LexiconScorer())
    assert cache.read().count() == 3


def test_spread_join_equals_left_join(spark):
    big = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 11}", i) for i in range(300)], "k string, i int")
    unique = spark.createDataFrame([("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(9)], "k string, v double")
    got = sorted(map(tuple, joins.spread_join(big, unique, ["k"], rows_per_task=20).select("k", "i", "v").collect()), key=repr)
    assert got == sorted(map(tuple, big.join(unique, "k", "left").select("k", "i", "v").collect()), key=repr)


def test_all_of_many_frequent_keys_are_dealt(spark):
    big = spark.range(24_000).selectExpr("concat('k', id % 2000) k", "id i")
    keys = joins.frequent_keys(joins.key_counts(big, ["k"]), ["k"], 5)
    assert keys.count() == 2000 and {r["_salts"] for r in keys.collect()} == {3}
    unique = spark.range(1500).selectExpr("concat('k', id) k", "id v")
    got = joins.spread_join(big, unique, ["k"], rows_per_task=5)
    assert got.count() == 24_000 and got.where("v is null").count() == 6_000
    assert got.where("k <> concat('k', v)").count() == 0


def test_two_writers_do_not_double_rows(spark, tmp_path):
    cache = sentiment.ScoreCache(spark, str(tmp_path / "scores"))
    df = spark.createDataFrame([("gain and profit", i) for i in range(9)], "headline string, seq int")
    cache.fill(df, sentiment.LexiconScorer())
    spark.read.parquet(cache.path).write.mode("append").parquet(cache.path + "2")
    spark.read.parquet(cache.path + "2").write.mode("append").parquet(cache.path)
    assert sentiment.score_cached(df, cache, sentiment.LexiconScorer()).count() == 9


def test_cache_merges_into_its_partitions(spark, tmp_path):
    cache = sentiment.ScoreCache(spark, str(tmp_path / "scores"))
    df = spark.range(3000).selectExpr("concat('profit number ', id) headline", "id seq")
    cache.fill(df.where("seq < 2000"), sentiment.LexiconScorer())
    keys = df.select(F.sha2("headline", 256).alias("text_key"), "seq")
    probed = cache.probe(keys)
    assert probed.where("seq < 2000 and not maybe").count() == 0  # a filter never rules out what is there
    assert probed.where("seq >= 2000 and maybe").count() < 50
    before = {r["text_key"]: r["pos"] for r in cache.read().collect()}
    # a second writer that did not see the first: old scores stay, nothing doubles
    late = df.where("seq >= 1900").select(F.sha2("headline", 256).alias("text_key"), *[F.lit(0.5).alias(c) for c in ("neu", "pos", "neg")], F.array(F.lit(0.5).cast("float")).alias("emb"))
    cache.merge(late)
    rows = cache.read().collect()
    assert len(rows) == len({r["text_key"] for r in rows}) == 3000
    assert all(r["pos"] == before.get(r["text_key"], 0.5) for r in rows)
    assert cache.misses(df).count() == 0


def test_lost_filters_and_scores_do_not_change_results(spark, tmp_path):
    df = spark.createDataFrame([("gain and profit", 1), ("fraud", 2), (None, 3), ("fraud", 4)], "headline string, seq int")
    want = {r["seq"]: r["pos"] for r in sentiment.score_inline(df).collect()}
    cache = sentiment.ScoreCache(spark, str(tmp_path / "scores"), prefix=2)
    cache.fill(df, sentiment.LexiconScorer())
    blind = sentiment.ScoreCache(spark, cache.path, prefix=2)
    blind.filters = str(tmp_path / "none")  # filters that lag behind
    assert {r["seq"]: r["pos"] for r in sentiment.score_cached(df, blind, sentiment.LexiconScorer()).collect()} == want
    assert cache.read().count() == 3
    ahead = sentiment.ScoreCache(spark, str(tmp_path / "empty"), prefix=2)
    ahead.filters = cache.filters  # filters of scores that another writer has replaced
    assert {r["seq"]: r["pos"] for r in sentiment.score_cached(df, ahead, sentiment.LexiconScorer()).collect()} == want


def test_model_scorer_keeps_rows_aligned_when_a_batch_fails(spark):
    def load():
        def model(texts):
            if "boom" in texts:
                raise RuntimeError("batch failed")
            return [[0.2, 0.5, 0.3]] * len(texts), [[float(len(t)), 1.0, 2.0] for t in texts]
        return model

    df = spark.createDataFrame([(f"k{i}", "boom" if i == 3 else "t" * i) for i in range(8)], "text_key string, headline string").coalesce(1)
    got = {r["text_key"]: r for r in sentiment.ModelScorer(load, dims=2, batch=2).score(df).collect()}
    assert got["k2"]["pos"] is None and got["k3"]["emb"] is None
    assert got["k7"]["emb"] == [7.0, 1.0] and got["k7"]["pos"] == 0.5 and len(got) == 8


def test_enrichment_fills_missing_dates(spark):
    price = spark.createDataFrame([("AAPL", dt.date(2024, 8, d)) for d in (1, 2, 3)], "symbol string, date date")
    real = spark.createDataFrame([("AAPL", dt.date(2024, 8, 1), "Real news")], "symbol string, date date, headline string")
    got = [tuple(r) for r in enrich.enrich_news(price, real).orderBy("date").collect()]
    assert [g[2] for g in got] == ["Real news", "AAPL news on 2024-08-02 (auto-generated)", "AAPL news on 2024-08-03 (auto-generated)"]
    assert enrich.enrich_news(price, real.limit(0)).count() == 3


def test_news_on_the_last_day_changes_the_inference_row(spark, linear_price):
    price = linear_price(60, symbol="A")
    last = price.agg(F.max("date")).first()[0].isoformat()

    def polarity(text):
        daily = sentiment.aggregate_daily(sentiment.score_inline(news(spark, [(last, text)])))
        return features.inference_rows(price, daily).first()["pos_minus_neg"]

    assert polarity("great record profit") > 0 > polarity("lawsuit and fraud scandal")


def test_trend_band(spark):
    df = spark.createDataFrame([("A", i, 0.2 if i < 8 else -0.4) for i in range(16)], "symbol string, date int, pos_minus_neg double")
    got = [r["band"] for r in series.add_sentiment_trend(df).orderBy("date").collect()]
    assert got[:6] == [None] * 6 and got[6] == "above" and got[-1] == "below" and "inside" in got


def test_wide_news_file(spark, tmp_path):
    path = tmp_path / "news.csv"
    path.write_text('Date,Top1,Top2,Top3\n2020-01-02,"b""quoted"" one",  padded  ,\n2020-01-01,"two\nlines",,three, \n', encoding="utf-8")
    got = sorted((r["date"].isoformat(), r["headline"]) for r in files.load_news(spark, str(path), lines_in_cells=True).collect())
    assert got == [("2020-01-01", "three"), ("2020-01-01", "two\nlines"), ("2020-01-02", 'b"quoted" one'), ("2020-01-02", "padded")]


def test_price_file(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("Date, Open,Adj Close \n2020-01-02,NaN,2.5\n", encoding="utf-8")
    row = files.load_price(spark, str(path)).first()
    assert row.asDict() == {"date": dt.date(2020, 1, 2), "open": None, "adj_close": 2.5}


def test_lenient_dates_in_uploads(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text("date,headline\n2020-01-02,a\nnope,b\n", encoding="utf-8")
    assert [r["date"] for r in files.load_csv(spark, str(path)).orderBy("headline").collect()] == ["2020-01-02", None]
    assert files.load_csv(spark, str(path), "when").columns == ["date", "headline"]


def test_price_history_window(spark):
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(i), *[1.0] * 6) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, adj_close double, volume double")
    got = history.price_history(df, "2024-02-10", 10, "A").agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert tuple(got) == (dt.date(2024, 1, 21), dt.date(2024, 2, 9), 20)
    with pytest.raises(ValueError):
        history.price_history(df, "2024-02-10", 10, "B", check=True)


def test_articles(spark):
    body = json.dumps({"articles": [
        {"publishedAt": "2024-01-05T10:00:00Z", "title": "Apple and apple", "source": {"id": None}},
        {"publishedAt": "2024-01-04T10:00:00Z", "title": "Apple"}, {"publishedAt": "2024-01-04T11:00:00Z", "title": "Pear"}]})
    raw = spark.createDataFrame([("A", body), ("A", '{"articles": []}'), ("A", "broken")], "symbol string, body string")
    rows = history.explode_articles(raw).withColumn("seq", F.monotonically_increasing_id())
    found = history.news_history(rows, "apple", "2024-01-05", 1, lang=None).orderBy(F.col("relevance").desc()).collect()
    assert [(r["date"].day, r["relevance"]) for r in found] == [(5, 2.0), (4, 1.0)]


def test_request_without_news_gives_no_news_rows(spark, tmp_path):
    entry = {"date": "2025-04-02", "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "adj_close": 1.0, "volume": 7}
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"symbol": "A", "price": [entry, {**entry, "date": "2025-04-03"}]}), encoding="utf-8")
    req = payload.read_requests(spark, str(path))
    assert payload.request_news(req).count() == 0
    assert [r["volume"] for r in payload.request_prices(req).collect()] == [7.0, 7.0]
