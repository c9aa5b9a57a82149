"""Small Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: quote currencies whose pairs trade every day (fixed values)
CONTINUOUS_QUOTES = ("USD", "EUR", "GBP", "JPY", "AUD", "CAD", "CHF", "BTC", "ETH")
TICKER_PATTERN = r"^[A-Za-z0-9^][A-Za-z0-9._^=-]{0,63}$"


def is_continuous(ticker: Column) -> Column:
    return F.upper(ticker).rlike("-(" + "|".join(CONTINUOUS_QUOTES) + ")$")


def annualization(ticker: Column) -> Column:
    return F.when(is_continuous(ticker), 365.0).otherwise(252.0)


def next_business_day(d: Column) -> Column:
    """Roll a weekend date forward to Monday."""
    weekday = F.dayofweek(d)
    return F.when(weekday == 7, F.date_add(d, 2)).when(weekday == 1, F.date_add(d, 1)).otherwise(d)


def previous_business_day(d: Column) -> Column:
    weekday = F.dayofweek(d)
    return F.when(weekday == 7, F.date_sub(d, 1)).when(weekday == 1, F.date_sub(d, 2)).otherwise(d)


def minus_business_days(d: Column, n: int) -> Column:
    """Business-day offset backwards from any date (n small)."""
    out = d
    for _ in range(n):
        out = previous_business_day(F.date_sub(out, 1))
    return out


def finite(x: Column) -> Column:
    """True for a known, non-NaN, non-infinite number."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)
