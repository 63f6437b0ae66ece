"""Calendar parts of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_day(ts) -> Column:
    """Calendar day as ISO text ``yyyy-MM-dd`` (sorts chronologically).

    Kept as text, as the curated tables of the original tool do, so the day
    reads the same through every client (Arrow, pandas, CSV, JSON).
    """
    return F.date_format(_c(ts), "yyyy-MM-dd")


def month_text(ts) -> Column:
    """``yyyy-MM`` month period as text."""
    return F.date_format(_c(ts), "yyyy-MM")


def weekday_name(ts) -> Column:
    """English weekday name (Monday ... Sunday)."""
    return F.date_format(_c(ts), "EEEE")
