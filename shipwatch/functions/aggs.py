"""Aggregate expressions with exact, order-independent results.

Floating-point sums depend on the order rows are added, which differs across
partitions and engines. Money is therefore summed as a decimal and converted
once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(38,6)"


def money_sum(c: Column | str) -> Column:
    """Exact sum of a money column; 0 (not null) over no rows."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.cast(MONEY)), F.lit(0).cast(MONEY)).cast("double")


def int_sum(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))


def rate(c: Column | str) -> Column:
    """Mean of a 0/1 (or integer) column as double; exact sum / count."""
    c = F.col(c) if isinstance(c, str) else c
    return F.avg(c)


def count_where(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")
