"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

SYMBOL_PATTERN = r"^[A-Za-z0-9_.^-]+\z"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Both ends stripped of all white space, not of blanks only."""
    return F.trim(col(c), F.lit(WHITESPACE))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def text_key(c: Column | str) -> Column:
    """Content address of a text, the key of the score cache."""
    return F.sha2(text_or_empty(c), 256)


def iso_day(c: Column | str) -> Column:
    """``2024-05-01T09:30:00Z`` -> ``2024-05-01`` (still text)."""
    return F.substring(col(c), 1, 10)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of ``term`` in ``text``, as a double."""
    return F.regexp_count(text, F.lit(rf"\Q{term}\E")).cast("double")


def fallback_headline(symbol: Column | str, date: Column | str) -> Column:
    return F.concat(
        col(symbol), F.lit(" news on "), F.date_format(col(date), "yyyy-MM-dd"), F.lit(" (auto-generated)")
    )


def symbol_valid(c: Column | str) -> Column:
    return col(c).rlike(SYMBOL_PATTERN)
