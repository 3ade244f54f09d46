import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tapewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def business_days(n, start=dt.date(2024, 1, 1)):
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += dt.timedelta(1)
    return out


@pytest.fixture
def linear_price(spark):
    """n business days from 2024-01-01, adj_close rising evenly."""
    def make(n, start=100.0, stop=150.0, symbol="X"):
        step = (stop - start) / (n - 1)
        rows = [(symbol, day, 0.0, 0.0, 0.0, 0.0, start + i * step, 0.0) for i, day in enumerate(business_days(n))]
        return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, adj_close double, volume double")

    return make
