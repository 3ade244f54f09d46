"""Numeric expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapewright.functions.text import col


def safe_log(c: Column | str) -> Column:
    """Natural log, NULL where the argument is not positive."""
    x = col(c)
    return F.when(x > 0, F.log(x))


def log_ratio(now: Column | str, before: Column | str) -> Column:
    """ln(now / before), NULL unless both are positive."""
    a, b = col(now), col(before)
    return F.when((a > 0) & (b > 0), F.log(a / b))


def softmax(*logits: Column) -> list[Column]:
    """Class probabilities; the maximum is subtracted first, so that exp cannot overflow."""
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    total = reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]


def as_double(c: Column | str) -> Column:
    """Number or NULL, never an error; NaN counts as missing."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def path_from_returns(p0: Column, returns: Column) -> Column:
    """Price path p0 * exp(r1), p0 * exp(r1 + r2), ... from an array of log returns."""
    return F.transform(cumulative(returns), lambda s: p0 * F.exp(s))


def cumulative(values: Column) -> Column:
    """Running sums of an array of doubles, in one pass over the array."""
    empty = F.array().cast("array<double>")
    return F.aggregate(
        values,
        empty,
        lambda acc, v: F.concat(
            acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v)
        ),
    )
