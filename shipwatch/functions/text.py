"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shipwatch.fixed_values import MISSING_TEXT


WHITESPACE = " \t\n\x0b\f\r"


def _strip(c: Column) -> Column:
    # plain trim() removes spaces only; strip every ASCII whitespace character
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(c: Column | str, *, nan_is_missing: bool = True,
               missing: str = MISSING_TEXT) -> Column:
    """Trim; null, empty (and, by default, the literal text ``nan``) -> UNKNOWN."""
    c = F.col(c) if isinstance(c, str) else c
    s = c.cast("string")
    t = _strip(s)
    blank = t.isin("", "nan") if nan_is_missing else (t == "")
    # most texts begin and end with a sign above the white space: they are looked at and not trimmed
    plain = (F.substring(s, 1, 1) > " ") & (F.substring(s, -1, 1) > " ")
    if nan_is_missing:
        plain = plain & (s != "nan")
    return F.when(plain, s).when(c.isNull() | blank, F.lit(missing)).otherwise(t)
