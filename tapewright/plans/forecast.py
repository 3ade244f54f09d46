"""From raw prices and news to price paths, and the tables behind forecast charts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.functions.calendar import business_days
from tapewright.functions.numeric import path_from_returns
from tapewright.models.base import FittedForecaster
from tapewright.operators.columns import require_columns
from tapewright.operators.enrich import enrich_news
from tapewright.operators.features import inference_rows
from tapewright.operators.guards import news_violations, price_violations
from tapewright.operators.joins import check_unique_dates
from tapewright.operators.sampling import dedupe_last, trim_news
from tapewright.operators.sentiment import LexiconScorer, add_polarity, aggregate_daily
from tapewright.operators.series import KEYS, add_successor, series_window
from tapewright.schemas import PRICE_COLUMNS
from tapewright.session import stage


def request_violations(price: DataFrame, news: DataFrame | None, keys=KEYS) -> DataFrame:
    """Series that break a request limit, with the table and the reason."""
    found = price_violations(price, keys).withColumn("source", F.lit("price"))
    if news is not None:
        found = found.unionByName(news_violations(news, keys).withColumn("source", F.lit("news")))
    return found


def batch_forecast(
    price: DataFrame,
    news: DataFrame | None,
    model: FittedForecaster,
    horizon: int = 30,
    scorer: LexiconScorer | None = None,
    enrich: bool = False,
    back: int = 7,
    dims: int = 17,
    limits: bool = False,
    arrival: str = "seq",
    keys=KEYS,
    per_day: int | None = None,
    total: int | None = None,
) -> DataFrame:
    """One forecast row per series; the path is NULL where the model does not know the series.

    All series, rows and headlines are used unless asked otherwise: ``limits`` leaves out
    series that break a request limit (:func:`request_violations` lists them), ``per_day`` and
    ``total`` cut the headlines of a request.  Only the model's own horizon bounds the path.
    Without an ``arrival`` column price dates must be unique.
    """
    require_columns(price, PRICE_COLUMNS)
    if arrival in price.columns:
        price = dedupe_last(price, [*keys, "date"], arrival).drop(arrival)
    else:
        check_unique_dates(price, keys)
    if limits:
        price = price.join(request_violations(price, news, keys).select(*keys).distinct(), list(keys), "left_anti")
    daily = None
    if news is not None:
        kept = trim_news(news, per_day, total, keys, arrival)
        if enrich:
            kept = enrich_news(price, kept, keys)
        scored = add_polarity((scorer or LexiconScorer(dims=dims)).score(kept, "headline"))
        daily = aggregate_daily(scored, dims, keys=keys)
    rows = inference_rows(price, daily, back, dims, keys)
    steps = min(horizon, model.horizon)
    path = F.array(*[F.col(p) for p in model.predictions[:steps]])
    return (
        model.transform(rows)
        .withColumn("log_return_path", path)
        .select(
            *keys,
            F.lit(steps).alias("horizon"),
            F.col("log_return_path")[0].alias("log_return"),
            F.col("adj_close").alias("current_price"),
            (F.col("adj_close") * F.exp(F.col("log_return_path")[0])).alias("predicted_price"),
            "log_return_path",
            path_from_returns(F.col("adj_close"), F.col("log_return_path")).alias("predicted_price_path"),
            business_days("date", steps).alias("predicted_dates"),
            F.col("date").alias("last_date"),
        )
    )


def explode_path(forecast: DataFrame, keys=KEYS) -> DataFrame:
    """(series, step, date, log_return, price), one row per step."""
    zipped = F.arrays_zip("predicted_dates", "log_return_path", "predicted_price_path")
    return forecast.select(*keys, F.posexplode(zipped).alias("step", "p")).select(
        *keys,
        (F.col("step") + 1).alias("step"),
        F.col("p.predicted_dates").alias("date"),
        F.col("p.log_return_path").alias("log_return"),
        F.col("p.predicted_price_path").alias("price"),
    )


def layered_chart(price: DataFrame, path: DataFrame, keys=KEYS) -> DataFrame:
    """Actual prices, the forecast path and its last point as tagged layers."""
    actual = price.select(*keys, "date", F.col("adj_close").alias("price"), F.lit("actual").alias("series"))
    predicted = path.select(*keys, "date", "price", F.lit("predicted").alias("series"))
    final = path.groupBy(*keys).agg(F.max_by(F.struct("date", "price"), "step").alias("p"))
    last = final.select(*keys, "p.date", "p.price", F.lit("last").alias("series"))
    return actual.unionByName(predicted).unionByName(last)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def h1_overlay(full: DataFrame, models: Mapping[str, FittedForecaster], keys=KEYS) -> DataFrame:
    """Next-day actual and predicted price for every test row that has a following row."""
    nexts = add_successor(full, ["date", "adj_close"], keys)
    test = nexts.where((F.col("split") == "test") & F.col("next_date").isNotNull())
    parts = []
    for kind, model in models.items():
        predicted = model.transform(test)
        parts.append(predicted.select(
            *keys, F.lit(kind).alias("kind"), F.col("next_date").alias("date"),
            F.col("next_adj_close").alias("actual"),
            (F.col("adj_close") * F.exp(F.col(model.predictions[0]))).alias("predicted"),
        ))
    return _union(parts)


def around_anchor(full: DataFrame, keys=KEYS) -> DataFrame:
    """Adds ``step``: 0 at the last test row, negative before, positive after."""
    w = series_window(keys)
    place = full.withColumn("_pos", F.row_number().over(w))
    anchor = F.max(F.when(F.col("split") == "test", F.col("_pos"))).over(W.partitionBy(*keys))
    return place.withColumn("step", (F.col("_pos") - anchor).cast("int")).drop("_pos")


def h_overlay_history(full: DataFrame, rows: int = 200, keys=KEYS) -> DataFrame:
    """The prices of the ``rows`` rows up to the anchor."""
    placed = around_anchor(full, keys)
    return placed.where((F.col("step") <= 0) & (F.col("step") > -rows)).select(*keys, "date", "step", "adj_close")


def h_overlay(full: DataFrame, models: Mapping[str, FittedForecaster], horizon: int, keys=KEYS) -> DataFrame:
    """(series, kind, step, date, actual, forecast) for the steps after the anchor that have an actual.

    Anchors and the ``horizon`` rows behind them are written once for all models.
    """
    placed = stage(around_anchor(full, keys).where(F.col("step").between(0, horizon)), "overlay")
    future = placed.where(F.col("step") > 0).select(
        *keys, "step", "date", F.col("adj_close").alias("actual")
    )
    anchors = placed.where(F.col("step") == 0).drop("step")
    parts = []
    for kind, model in models.items():
        returns = F.array(*[F.col(p) for p in model.predictions[:horizon]])
        path = path_from_returns(F.col("adj_close"), returns)
        parts.append(
            model.transform(anchors).select(*keys, F.lit(kind).alias("kind"), F.posexplode(path).alias("_at", "forecast"))
            .withColumn("step", F.col("_at") + 1).drop("_at")
        )
    return _union(parts).join(future, [*keys, "step"]).select(*keys, "kind", "step", "date", "actual", "forecast")


def diagnostics(overlay: DataFrame, keys=KEYS) -> DataFrame:
    """Residuals and cumulative log returns per step.

    ``cum_*`` is ln(y_k / y_1).  ``cumsum_*`` is the running sum of those values, kept for
    comparison with charts that add them up once more.
    """
    w = W.partitionBy(*keys, "kind").orderBy("step")
    running = w.rowsBetween(W.unboundedPreceding, 0)
    out = overlay.withColumns({
        "residual": F.col("actual") - F.col("forecast"),
        "cum_actual": F.log(F.col("actual") / F.first("actual").over(running)),
        "cum_forecast": F.log(F.col("forecast") / F.first("forecast").over(running)),
    })
    return out.withColumns({
        "cumsum_actual": F.sum("cum_actual").over(running),
        "cumsum_forecast": F.sum("cum_forecast").over(running),
    })
