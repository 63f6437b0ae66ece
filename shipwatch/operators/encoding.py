"""One-hot encoding by a table of slots.

The encoder is the table ``encoder_slots`` (feature, value, n, slot): rows meet
it by one equi join a feature, which is a broadcast if that feature has few
values. No vocabulary passes the driver; what does are the numbers of slots,
one a feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shipwatch import fixed_values as fv

CAT = fv.CATEGORICAL_FEATURES

# A feature of so few values is sent to the rows: without that, Spark's estimate (the file of
# all features) has the rows shuffled by a text of few values, into as few tasks.
FEW_VALUES = 10_000


def slot_column(feature: str) -> str:
    return f"{feature}__slot"


def shared_slots(slots: DataFrame) -> Column:
    """The shared slot of every feature, as a map by feature (a scalar subquery of a row a feature)."""
    return slots.where("value is null").agg(F.map_from_entries(F.collect_list(F.struct("feature", "slot")))).scalar()


def sent_if_few(table: DataFrame) -> Callable[[str, DataFrame], DataFrame]:
    """Marks a feature's part of ``table`` (a row a feature and value) to be broadcast if it has few values.

    The numbers of values are counted first: some numbers, one a feature.
    """
    counts = dict(table.where("value is not null").groupBy("feature").agg(F.count(F.lit(1))).collect())
    return lambda feature, part: F.broadcast(part) if counts.get(feature, 0) <= FEW_VALUES else part


def with_slots(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Add ``<feature>__slot`` of every categorical feature.

    Rare values, and values that the table does not know, take the shared slot.
    """
    sent = sent_if_few(slots)
    shared = shared_slots(slots)
    out = rows
    for c in CAT:
        mine = slots.where((F.col("feature") == c) & F.col("value").isNotNull()).select(
            F.col("value").alias(f"{c}__value"), F.col("slot").alias(slot_column(c)))
        out = out.join(sent(c, mine), F.col(c).cast("string") == F.col(f"{c}__value"), "left").drop(f"{c}__value")
    return out.withColumns({slot_column(c): F.coalesce(slot_column(c), F.element_at(shared, F.lit(c))) for c in CAT})


def first_indexes(slots: DataFrame) -> dict[str, Column]:
    """Where each feature's slots begin among those of all features in their fixed order."""
    widths = slots.groupBy("feature").agg((F.max("slot") + 1).alias("width"))           # a row a feature
    width = widths.agg(F.map_from_entries(F.collect_list(F.struct("feature", "width")))).scalar()
    at, out = F.lit(0).cast("int"), {}
    for c in CAT:
        out[c] = at
        at = at + F.element_at(width, F.lit(c))
    return out


def indexed_slots(slots: DataFrame) -> DataFrame:
    """``slots`` with ``index``, the place among the slots of all features."""
    first = F.lit(None).cast("int")
    for c, at in first_indexes(slots).items():
        first = F.when(F.col("feature") == c, at).otherwise(first)
    return slots.withColumn("index", (first + F.col("slot")).cast("int"))


def encoded_rows(rows: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    """(key, slots): the sorted indexes of the ones in the encoded row, one a feature."""
    ones = [(at + F.col(slot_column(c))).cast("int") for c, at in first_indexes(slots).items()]
    return with_slots(rows.select(key, *CAT), slots).select(key, F.sort_array(F.array(*ones)).alias("slots"))
