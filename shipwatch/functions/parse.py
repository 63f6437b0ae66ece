"""Lenient parsers: bad text becomes null instead of failing the job.

ANSI mode is on by default in Spark 4, so plain casts raise on bad input;
these use the ``try_`` family.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shipwatch.functions.text import WHITESPACE

# The shapes of timestamps that are read: month/day/year, or ISO, each with or
# without a time, whose seconds may be left out.
TIMESTAMP_SHAPE = (r"^(\d{1,2}/\d{1,2}/\d{4}( \d{1,2}:\d{2}(:\d{2})?)?"
                   r"|\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?)$")


def parse_timestamp(c: Column | str) -> Column:
    """Text -> zone-less timestamp; text of another shape, or no such day -> null.

    The text is brought into ISO order and parsed once.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.btrim(c.cast("string"), F.lit(WHITESPACE))
    iso = F.regexp_replace(s, r"^(\d+)/(\d+)/(\d+)", "$3-$1-$2")
    iso = F.regexp_replace(iso, r"^(\S+)[ T](\d+:\d+)$", "$1 $2:00")
    return F.when(s.rlike(TIMESTAMP_SHAPE), iso).try_cast("timestamp_ntz")


def parse_number(c: Column | str, to: str = "double") -> Column:
    """Text -> number, unparsable -> null.

    Integers are exact: their digits are read as such, after a fraction of
    zeros (``12.0``) is taken off; any other fraction is no integer. ``nan``,
    infinities and the type suffixes that casts accept (``1d``, ``2f``) are no
    numbers: text that ends with a letter is none.
    """
    c = F.col(c) if isinstance(c, str) else c
    s = F.btrim(c.cast("string"), F.lit(WHITESPACE))
    if to in ("int", "bigint", "long"):
        return F.when(s.contains("."), F.regexp_replace(s, r"^([+-]?[0-9]+)\.0*$", "$1")).otherwise(s).try_cast(to)
    return F.when(~s.rlike("[A-Za-z]$"), s).try_cast(to)


def parse_hour(c: Column | str) -> Column:
    """Hour text -> int, anything unparsable -> -1."""
    return F.coalesce(parse_number(c, "int"), F.lit(-1))
