"""Queries on headlines: sources, scoring, cache, joins, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import text as tx
from tapewright.functions.arrays import flatten_dims, truncate_dims
from tapewright.functions.numeric import softmax
from tapewright.operators import columns, enrich, features, joins, sampling, sentiment, series
from tapewright.session import stage_path
from tapewright.sinks.tables import write_stage
from tapewright.sources import files, history, payload
from tapewright.workloads.registry import EMB, SENTIMENT, query
from tapewright.workloads.series_queries import KD, PRICES
from tapewright.workloads.views import bars, news, table

WIDTH = 25  # headline columns of a wide news file
WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||" + "||".join(
    f"chr({c})" for c in [*range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
STRIPPED = f"trim(text, {WS})"


def wide_news(spark, d):
    """Documents dealt into rows of Top1..Top25, as in a wide news file."""
    doc = F.col("doc_id")
    cells = table(spark, d, "documents").select(
        F.floor(doc / WIDTH).alias("Sheet"), (F.pmod(doc, F.lit(WIDTH)) + 1).alias("slot"), F.concat(F.lit("  "), "text", F.lit(" \t")).alias("text"))
    wide = cells.groupBy("Sheet").pivot("slot", list(range(1, WIDTH + 1))).agg(F.first("text"))
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(F.col("Sheet"), F.lit(2400)).cast("int"))
    return wide.select("Sheet", day.alias("Date"), *[F.col(str(i)).alias(f"Top{i}") for i in range(1, WIDTH + 1)])


@query("news_unpivot", f"""SELECT doc_id // 25 AS sheet, DATE '1995-01-01' + CAST((doc_id // 25) % 2400 AS INTEGER) AS date, {STRIPPED} AS headline
FROM documents WHERE text IS NOT NULL""")
def news_unpivot(spark, d):
    return files.melt_news(wide_news(spark, d), ["Sheet", "Date"])


@query("csv_price_load", "SELECT * FROM v_price", PRICES)
def csv_price_load(spark, d):
    """Bars leave as a CSV with untidy headers and come back through the price loader."""
    named = bars(spark, d).toDF("Symbol", "Date", "Open", " High", "Low ", "Close", "Adj Close", " Volume")
    path = write_stage(named, stage_path(spark, "prices-csv"), csv=True)
    return files.load_price(spark, path)


@query("csv_dates_coerced", """SELECT symbol, CASE WHEN day(date) <> 13 THEN strftime(date, '%Y-%m-%d') END AS date, volume FROM v_price""", ["volume"])
def csv_dates_coerced(spark, d):
    """A CSV whose dates are partly unreadable: those become NULL, no row is lost."""
    odd = F.when(F.dayofmonth("date") == 13, F.lit("13th")).otherwise(F.col("date").cast("string"))
    raw = bars(spark, d).select("symbol", odd.alias("date"), "volume")
    path = write_stage(raw, stage_path(spark, "dates-csv"), csv=True)
    return files.load_csv(spark, path).withColumn("volume", F.col("volume").cast("double"))


@query("stage_roundtrip", f"SELECT symbol, date, adj_close, {', '.join(SENTIMENT)} FROM v_panel", ["adj_close", *SENTIMENT])
def stage_roundtrip(spark, d):
    """Prices with sentiment through the Parquet stage between two steps."""
    panel = joins.merge_price_news(bars(spark, d), daily(spark, d).drop("headline_count"))
    path = write_stage(panel, stage_path(spark, "prices-with-sentiment"))
    return files.read_stage(spark, path).select(*KD, "adj_close", *SENTIMENT)


@query("news_history", """SELECT symbol, published, date, headline, relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY relevance DESC, seq) AS rn FROM (
    SELECT symbol, strftime(date, '%Y-%m-%d') || 'T09:30:00Z' AS published, date, headline, seq,
      CAST(length(lower(headline)) - length(replace(lower(headline), 'the', '')) AS DOUBLE) / 3 AS relevance
    FROM v_news WHERE lang = 'en' AND date >= DATE '2000-01-01' - 1500 AND date <= DATE '2000-01-01') WHERE relevance > 0) WHERE rn <= 100""",
       ["relevance"])
def news_history(spark, d):
    """Article bodies as JSON -> rows -> most relevant English articles of the look-back window."""
    stamp = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T09:30:00Z"))
    article = F.struct(stamp.alias("publishedAt"), F.col("headline").alias("title"))
    bodies = news(spark, d).select("symbol", "seq", "lang", F.to_json(F.struct(F.array(article).alias("articles"))).alias("body"))
    articles = history.explode_articles(bodies, keep=["symbol", "seq", "lang"])
    found = history.news_history(articles, "the", "2000-01-01", 1500)
    return found.select("symbol", "published", "date", "headline", "relevance")


def requests(spark, d):
    """Prediction requests as JSON bodies: the bars of one quarter and, for odd years, one headline per day."""
    day = F.date_format("date", "yyyy-MM-dd")
    price = bars(spark, d).groupBy("symbol", F.date_trunc("quarter", "date").alias("quarter")).agg(
        F.sort_array(F.collect_list(F.struct(day.alias("date"), "open", "high", "low", "close", "adj_close", "volume"))).alias("price"),
        F.sort_array(F.collect_list(F.struct(day.alias("date"), F.concat(F.lit("volume "), F.col("volume").cast("int")).alias("headline")))).alias("news"))
    some = F.when(F.year("quarter") % 2 == 1, F.col("news"))
    return payload.parse_requests(price.select(F.to_json(F.struct("symbol", "price", some.alias("news"))).alias("body")))


@query("payload_price", "SELECT * FROM v_price", PRICES)
def payload_price(spark, d):
    return payload.request_prices(requests(spark, d)).drop("seq")


@query("payload_news", "SELECT symbol, date, 'volume ' || CAST(CAST(volume AS INTEGER) AS VARCHAR) AS headline FROM v_price WHERE year(date) % 2 = 1")
def payload_news(spark, d):
    return payload.request_news(requests(spark, d)).drop("seq")


# --- text ------------------------------------------------------------------------------------

@query("text_strip", f"SELECT conv_id, turn, {STRIPPED} AS text, length({STRIPPED}) AS n FROM conversations")
def text_strip(spark, d):
    raw = table(spark, d, "conversations")
    return raw.select("conv_id", "turn", tx.strip("text").alias("text")).withColumn("n", F.length("text").cast("long"))


@query("text_sha256", "SELECT doc_id, sha256(coalesce(text, '')) AS text_key FROM documents")
def text_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.text_key("text").alias("text_key"))


@query("null_text", "SELECT doc_id, length(coalesce(CASE WHEN toxic = 0 THEN text END, '')) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def null_text(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    shown = F.when(F.col("toxic") == 0, F.col("text"))
    return docs.select("doc_id", F.length(tx.text_or_empty(shown)).cast("long").alias("n"))


@query("iso_prefix", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def iso_prefix(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("event_id", tx.iso_day(stamp).alias("day"))


@query("fallback_headlines", "SELECT symbol, date, symbol || ' news on ' || strftime(date, '%Y-%m-%d') || ' (auto-generated)' AS headline FROM v_price")
def fallback_headlines(spark, d):
    return bars(spark, d).select(*KD, tx.fallback_headline("symbol", "date").alias("headline"))


@query("softmax", """SELECT event_id, exp(value - m) / z AS a, exp(10 - m) / z AS b, exp(-value - m) / z AS c FROM (
  SELECT *, exp(value - m) + exp(10 - m) + exp(-value - m) AS z FROM (SELECT event_id, value, greatest(value, CAST(10 AS DOUBLE), -value) AS m FROM events))""",
       ["a", "b", "c"])
def softmax_query(spark, d):
    ev = table(spark, d, "events")
    a, b, c = softmax(F.col("value"), F.lit(10.0), -F.col("value"))
    return ev.select("event_id", a.alias("a"), b.alias("b"), c.alias("c"))


@query("mean_pool", f"""SELECT label, {', '.join(f'avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS emb_{i}' for i in range(17))}, count(*) AS n FROM embeddings GROUP BY label""", EMB)
def mean_pool(spark, d):
    """Vectors cut to 17 dimensions and averaged by position, per label."""
    cut = table(spark, d, "embeddings").select("label", truncate_dims("embedding", 17).alias("emb"))
    flat = cut.select("label", *flatten_dims("emb", 17))
    return flat.groupBy("label").agg(*[F.avg(c).alias(c) for c in EMB], F.count(F.lit(1)).alias("n"))


# --- scores and daily sentiment ---------------------------------------------------------------

def scored(spark, d):
    return sentiment.score_inline(news(spark, d))


def daily(spark, d):
    return sentiment.aggregate_daily(scored(spark, d))


@query("news_scored", f"SELECT symbol, date, seq, {', '.join(SENTIMENT)}, {', '.join(EMB)} FROM v_scored", [*SENTIMENT, *EMB])
def news_scored(spark, d):
    return scored(spark, d).select("symbol", "date", "seq", *SENTIMENT, *flatten_dims("emb", 17))


@query("daily_sentiment", "SELECT * FROM v_daily", [*SENTIMENT, *EMB])
def daily_sentiment(spark, d):
    return daily(spark, d)


@query("sentiment_rolling7", """SELECT symbol, date, smoothed, CASE WHEN smoothed > 0.05 THEN 'above' WHEN smoothed < -0.05 THEN 'below'
  WHEN smoothed IS NOT NULL THEN 'inside' END AS band
FROM (SELECT symbol, date, CASE WHEN count(pos_minus_neg) OVER w = 7 THEN avg(pos_minus_neg) OVER w END AS smoothed
  FROM v_daily WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 6 PRECEDING))""", ["smoothed"])
def sentiment_rolling7(spark, d):
    return series.add_sentiment_trend(daily(spark, d)).select(*KD, "smoothed", "band")


@query("cache_misses", """SELECT DISTINCT sha256(headline) AS text_key FROM v_news
WHERE sha256(headline) NOT IN (SELECT sha256(headline) FROM v_news WHERE symbol IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))""")
def cache_misses(spark, d):
    """Three series fill the cache; what is left are the distinct other texts."""
    rows = news(spark, d)
    cache = sentiment.ScoreCache(spark, stage_path(spark, "scores"))
    cache.fill(rows.where(F.col("symbol").isin("1-URGENT", "2-HIGH", "3-MEDIUM")), sentiment.LexiconScorer())
    return cache.misses(rows).select("text_key")


@query("score_cache", f"SELECT symbol, seq, {', '.join(SENTIMENT)} FROM v_scored", SENTIMENT)
def score_cache(spark, d):
    """Every row scored through the cache, each distinct text once."""
    cache = sentiment.ScoreCache(spark, stage_path(spark, "scores"))
    out = sentiment.score_cached(news(spark, d), cache, sentiment.LexiconScorer(), rows_per_task=3)
    return out.select("symbol", "seq", *SENTIMENT)


# --- joins, caps, sets -------------------------------------------------------------------------

@query("price_news_join", f"SELECT * FROM v_panel", [*PRICES, *SENTIMENT, *EMB])
def price_news_join(spark, d):
    return joins.merge_price_news(bars(spark, d), daily(spark, d).drop("headline_count"))


@query("price_news_rows", """SELECT p.symbol, p.date, p.adj_close, n.seq FROM v_price p LEFT JOIN v_news n ON p.symbol = n.symbol AND p.date = n.date""", ["adj_close"])
def price_news_rows(spark, d):
    """One-to-many: a price row per headline of its date."""
    rows = joins.merge_price_news(bars(spark, d), news(spark, d).select(*KD, "seq"), validate=True, many=True, rows_per_task=3)
    return rows.select(*KD, "adj_close", "seq")


@query("missing_news_dates", """SELECT symbol, date FROM v_price EXCEPT SELECT symbol, date FROM v_news""")
def missing_news_dates(spark, d):
    return joins.missing_news_dates(bars(spark, d), news(spark, d))


@query("date_difference", """SELECT DISTINCT date FROM v_price WHERE date NOT IN (SELECT date FROM v_news)""")
def date_difference(spark, d):
    return bars(spark, d).select("date").subtract(news(spark, d).select("date"))


@query("first20_per_date", """SELECT symbol, date, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq) AS rn FROM v_news) WHERE rn <= 20""")
def first20_per_date(spark, d):
    return sampling.keep_first(news(spark, d), KD, ["seq"], 20).select(*KD, "seq")


@query("trimmed_news", """SELECT symbol, date, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC, seq DESC) AS back FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq) AS rn FROM v_news) WHERE rn <= 20) WHERE back <= 1000""")
def trimmed_news(spark, d):
    return sampling.trim_news(news(spark, d)).select(*KD, "seq")


@query("enriched_news", """SELECT symbol, date, headline, false AS generated FROM v_news
UNION ALL SELECT symbol, date, symbol || ' news on ' || strftime(date, '%Y-%m-%d') || ' (auto-generated)', true FROM (
  SELECT symbol, date FROM v_price EXCEPT SELECT symbol, date FROM v_news)""")
def enriched_news(spark, d):
    return enrich.enrich_news(bars(spark, d), news(spark, d))


@query("zero_sentiment", f"SELECT *, {', '.join(f'CAST(0 AS DOUBLE) AS {c}' for c in [*SENTIMENT, *EMB])} FROM v_price", [*PRICES, *SENTIMENT, *EMB])
def zero_sentiment(spark, d):
    return features.merged_panel(bars(spark, d), None)


@query("ablation_selection", "SELECT symbol, date, log_return, " + ", ".join(f"lag_{k}" for k in range(1, 8)) + ", quarter, dow FROM v_features5",
       ["log_return", *[f"lag_{k}" for k in range(1, 8)]])
def ablation_selection(spark, d):
    """The model inputs without anything that stems from news."""
    full = features.create_features(features.merged_panel(bars(spark, d), daily(spark, d)), 5)
    return full.select(*KD, *columns.feature_columns(full, include_sentiment=False))


_LAST = ["log_return", *[f"lag_{k}" for k in range(1, 8)]]


@query("inference_row", f"""SELECT f.symbol, f.date, f.adj_close, {', '.join(f'f.{c}' for c in _LAST)}, f.quarter, f.dow, {', '.join(f'd.{c}' for c in [*SENTIMENT, *EMB])}
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM v_features5) f
LEFT JOIN v_daily d ON d.symbol = f.symbol AND d.date = f.date WHERE f.rn = 1""", ["adj_close", *_LAST, *SENTIMENT, *EMB])
def inference_row(spark, d):
    rows = features.inference_rows(bars(spark, d), daily(spark, d))
    return rows.select(*KD, "adj_close", *_LAST, "quarter", "dow", *SENTIMENT, *EMB)
