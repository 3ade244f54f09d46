"""Date expressions.  Everything is a DATE; no time zone can shift a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.text import col


def parse_day(c: Column | str) -> Column:
    """Strict: a bad date is an error."""
    return F.to_date(col(c), "yyyy-MM-dd")


def coerce_day(c: Column | str) -> Column:
    """Lenient: a bad date becomes NULL."""
    return F.try_to_date(col(c).cast("string"), "yyyy-MM-dd")


def format_day(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def quarter(c: Column | str) -> Column:
    return F.quarter(col(c)).cast("int")


def day_of_week(c: Column | str) -> Column:
    """Monday = 0."""
    return F.weekday(col(c)).cast("int")


def business_days(last: Column | str, n: int) -> Column:
    """The ``n`` weekdays after ``last`` as an array of dates."""
    first, end = F.date_add(col(last), 1), F.date_add(col(last), 2 * n + 7)
    weekdays = F.filter(F.sequence(first, end), lambda d: F.weekday(d) < 5)
    return F.slice(weekdays, 1, n)
