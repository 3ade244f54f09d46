"""Explicit schemas of the tables that come from outside."""

from pyspark.sql import types as T

PRICE_COLUMNS = ("date", "open", "high", "low", "close", "adj_close", "volume")
OHLCV = ("open", "high", "low", "close", "volume", "adj_close")
SENTIMENT_COLUMNS = ("pos", "neu", "neg", "pos_minus_neg")

PRICE_ROW = T.StructType(
    [T.StructField("date", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICE_COLUMNS[1:]]
)
NEWS_ROW = T.StructType(
    [T.StructField("date", T.StringType()), T.StructField("headline", T.StringType())]
)
REQUEST = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("price", T.ArrayType(PRICE_ROW)),
        T.StructField("news", T.ArrayType(NEWS_ROW)),
    ]
)
ARTICLES = T.StructType(
    [
        T.StructField(
            "articles",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("publishedAt", T.StringType()),
                        T.StructField("title", T.StringType()),
                    ]
                )
            ),
        )
    ]
)
