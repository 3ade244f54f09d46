"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show.

    floor(x * 10^d + 0.5) is plain arithmetic, the same in both engines, and much cheaper
    than decimal rounding.
    """
    unit = float(10**digits)

    def one(f: T.StructField):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (F.floor(F.col(f.name).cast("double") * unit + 0.5) / unit).alias(f.name)
        return F.col(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), digits: int = DIGITS):
    """Register a query; ``sql`` is its check, whose ``doubles`` are rounded like the result."""
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql is not None:
            swaps = ", ".join(f"floor(CAST({c} AS DOUBLE) * 1e{digits} + CAST(0.5 AS DOUBLE)) / 1e{digits} AS {c}" for c in doubles)
            replace = f" REPLACE ({swaps})" if swaps else ""
            ORACLES[name] = f"{with_views(sql)}SELECT *{replace} FROM ({sql.strip()}) AS q"
        return fn

    return add


# --- views of the check SQL; each may use those before it -------------------------------

LAGS = range(1, 8)
H30 = range(1, 31)
H5 = range(1, 6)


def features_sql(horizons: range) -> str:
    leads = ", ".join(f"lead(log_return, {h}) OVER w AS target_{h}" for h in horizons)
    lags = ", ".join(f"lag(log_return, {k}) OVER w AS lag_{k}" for k in LAGS)
    return f"""
SELECT * EXCLUDE (pos) FROM (
  SELECT *, {leads}, {lags}, CAST(quarter(date) AS INTEGER) AS quarter,
         CAST(isodow(date) - 1 AS INTEGER) AS dow, row_number() OVER w - 1 AS pos
  FROM v_returns WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE pos >= 7"""


def split_sql(source: str, horizons: range) -> str:
    known = " AND ".join(f"target_{h} IS NOT NULL" for h in horizons)
    return f"""
SELECT * EXCLUDE (ok, rnk, total, from_end),
  CASE WHEN NOT ok THEN NULL
       WHEN rnk < floor(total * CAST(0.8 AS DOUBLE)) THEN 'train'
       WHEN rnk < floor(total * (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))) THEN 'val'
       ELSE 'test' END AS split,
  from_end <= {len(horizons)} AS is_forecast
FROM (SELECT *, sum(CAST(ok AS BIGINT)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS rnk,
        sum(CAST(ok AS BIGINT)) OVER (PARTITION BY symbol) AS total,
        row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS from_end
      FROM (SELECT *, ({known}) AS ok FROM {source}))"""


def counts_sql(terms: Sequence[str]) -> str:
    return ", ".join(f"CAST(length(t) - length(replace(t, '{w}', '')) AS DOUBLE) / {len(w)} AS c{i}" for i, w in enumerate(terms))


def _lexicon() -> tuple[str, str, str, str]:
    from tapewright.operators.sentiment import NEGATIVE, POSITIVE

    terms = [*POSITIVE, *NEGATIVE]
    pos = " + ".join(f"c{i}" for i in range(len(POSITIVE)))
    neg = " + ".join(f"c{i}" for i in range(len(POSITIVE), len(terms)))
    emb = ", ".join(f"CAST(CAST(ln(1 + c{i}) AS FLOAT) AS DOUBLE) AS emb_{i}" for i in range(17))
    return counts_sql(terms), pos, neg, emb


_counts, _pos, _neg, _emb = _lexicon()
EMB = [f"emb_{i}" for i in range(17)]
SENTIMENT = ["pos", "neu", "neg", "pos_minus_neg"]

VIEWS: dict[str, str] = {
    "v_price": """
SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
  arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, avg(o_totalprice) AS adj_close, CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY 1, 2""",
    "v_news": """
SELECT CASE doc_id % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
       WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS symbol,
  DATE '1995-01-01' + CAST(40 * ((doc_id // 5) % 60) AS INTEGER) AS date,
  doc_id AS seq, text AS headline, lang FROM documents""",
    "v_ticks": "SELECT event_type AS symbol, ts, event_id AS seq, value FROM events",
    "v_returns": """
SELECT *, CASE WHEN adj_close > 0 AND lag(adj_close) OVER w > 0
               THEN ln(adj_close / lag(adj_close) OVER w) END AS log_return
FROM v_price WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "v_known": "SELECT * FROM v_returns WHERE log_return IS NOT NULL",
    "v_features30": features_sql(H30),
    "v_split30": split_sql("v_features30", H30),
    "v_features5": features_sql(H5),
    "v_split5": split_sql("v_features5", H5),
    "v_scored": f"""
SELECT symbol, date, seq, headline, neu, pos, neg, pos - neg AS pos_minus_neg, {", ".join(EMB)}
FROM (SELECT *, exp(1 - m) / z AS neu, exp(lp - m) / z AS pos, exp(ln_ - m) / z AS neg
      FROM (SELECT *, exp(1 - m) + exp(lp - m) + exp(ln_ - m) AS z
            FROM (SELECT *, greatest(CAST(1 AS DOUBLE), lp, ln_) AS m
                  FROM (SELECT symbol, date, seq, headline, ln(1 + {_pos}) AS lp, ln(1 + {_neg}) AS ln_, {_emb}
                        FROM (SELECT *, {_counts} FROM (SELECT *, lower(coalesce(headline, '')) AS t FROM v_news))))))""",
    "v_daily": f"""
SELECT symbol, date, {", ".join(f"coalesce(avg({c}), 0) AS {c}" for c in [*SENTIMENT, *EMB])},
  count(headline) AS headline_count FROM v_scored GROUP BY 1, 2""",
    "v_panel": f"""
SELECT p.*, {", ".join(f"d.{c}" for c in [*SENTIMENT, *EMB])}
FROM v_price p LEFT JOIN v_daily d ON p.symbol = d.symbol AND p.date = d.date""",
}


def with_views(sql: str) -> str:
    """WITH clause for the views that ``sql`` uses, directly or not."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and any(part == name for part in _words(text)):
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed) + "\n"


def _words(text: str) -> set[str]:
    return set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())
