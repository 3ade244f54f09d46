"""Tapewright: market forecasting and news sentiment over panels of time series, on Spark.

Every operator takes the series key(s) (``keys=("symbol",)``) and an order column, so
that one job serves all series at once.  A single series is a panel with one symbol.
"""

__version__ = "0.1.0"
