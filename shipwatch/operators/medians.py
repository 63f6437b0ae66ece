"""Exact medians by radix selection, as one lazy plan.

Doubles become whole numbers in the same order. The distinct values of all
columns are counted once (summed per task before their exchange); four rounds
then read off the two middle values 16 bits at a time: a histogram of at most
65,536 digits a column, summed per task, tells the next digits of the wanted
ranks. The number of rounds is the same for any data, and no task holds more
than a histogram. The exchange of the counted values serves all rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shipwatch.operators.schema_ops import unpivoted

DIGIT_BITS = 16
KEY_BITS = 64
_MANTISSA = 1 << 52
_SMALLEST_EXPONENT, _LARGEST_EXPONENT = -1022, 1023
_INFINITE = (_LARGEST_EXPONENT + 2 - _SMALLEST_EXPONENT) * _MANTISSA


def with_order_key(df: DataFrame, value: str = "v") -> DataFrame:
    """Add ``key``, a long that is ordered as the double ``value`` is (nan above all numbers).

    The bits of the double, put together from its exponent and mantissa: powers
    of two and divisions by them are exact, and the estimate of the exponent is
    set right by comparing with its power. Step by step, so that each step is
    computed once a row.
    """
    v, low, high = F.col(value), F.lit(float(_SMALLEST_EXPONENT)), F.lit(float(_LARGEST_EXPONENT))
    out = df.withColumn("_size", F.abs(v))
    out = out.withColumn("_guess", F.greatest(low, F.least(high, F.floor(F.log2("_size")).cast("double"))))
    out = out.withColumn("_power", F.pow(F.lit(2.0), F.col("_guess")))
    out = out.withColumn("_exponent", F.when(F.col("_size") < F.col("_power"), F.greatest(F.col("_guess") - 1, low))
                         .when((F.col("_size") / 2.0 >= F.col("_power")) & (F.col("_guess") < high), F.col("_guess") + 1)
                         .otherwise(F.col("_guess")))
    # below the smallest normal number there is no leading one: the quotient is the fraction itself
    out = out.withColumn("_units", F.col("_size") / F.pow(F.lit(2.0), F.col("_exponent")) * float(_MANTISSA))
    key = (F.col("_exponent") - _SMALLEST_EXPONENT).cast("long") * _MANTISSA + F.when(F.col("_size") < float("inf"), F.col("_units")).otherwise(0.0).cast("long")
    out = out.withColumn("key", F.when(F.col("_size") == 0.0, F.lit(0).cast("long")).when(F.isnan(v), F.lit((1 << 63) - 1))
                         .when(F.col("_size") == float("inf"), F.lit(_INFINITE)).otherwise(key))
    # never null: else joins would filter on it, below the steps, and compute them again
    signed = F.coalesce(F.when(v < 0, -F.col("key")).otherwise(F.col("key")), F.lit(0).cast("long"))
    return out.withColumn("key", signed).drop("_size", "_guess", "_power", "_exponent", "_units")


def value_of_key(key: Column) -> Column:
    """The double of an order key."""
    size = F.abs(key)
    units = size % _MANTISSA
    exponent = F.shiftright(size, 52).cast("double")
    leading = F.when(exponent == 0, 0.0).otherwise(1.0)
    power = F.pow(F.lit(2.0), F.greatest(exponent - 1, F.lit(0.0)) + _SMALLEST_EXPONENT)
    value = F.when(size == _INFINITE, float("inf")).when(size == (1 << 63) - 1, float("nan")) \
        .otherwise((leading + units.cast("double") / float(_MANTISSA)) * power)
    return F.when(key < 0, -value).otherwise(value)


def median_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, median, min, max) of each column that has a value; runs no job.

    The median of an even number of values is the mean of the two in the middle.
    """
    tall = unpivoted(df, columns, "double", "v").where("v is not null")
    counts = with_order_key(tall).groupBy("feature", "key").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    wanted = ends.select("feature", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.expr("(n + 1) div 2").alias("rank")),
        F.struct(F.lit(1).alias("which"), F.expr("n div 2 + 1").alias("rank")))).alias("w")).select("feature", "w.*")
    before = Window.partitionBy("feature", "which").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    shift = KEY_BITS
    while shift:
        shift -= DIGIT_BITS
        # two rows a column
        rows = counts.join(F.broadcast(wanted.withColumnRenamed("feature", "of")), F.col("feature") == F.col("of")).drop("of")
        if "prefix" in wanted.columns:
            rows = rows.where(F.shiftright("key", shift + DIGIT_BITS) == F.col("prefix"))
        digits = rows.groupBy("feature", "which", "rank", F.shiftright("key", shift).alias("digit")).agg(F.sum("n").alias("n"))
        placed = digits.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        hit = placed.where((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n")))
        wanted = hit.select("feature", "which", (F.col("rank") - F.col("below")).alias("rank"), F.col("digit").alias("prefix"))
    # all 64 bits of the two middle values are read
    low, high = (value_of_key(F.max(F.when(F.col("which") == k, F.col("prefix")))) for k in (0, 1))
    middle = wanted.groupBy("feature").agg(low.alias("a"), high.alias("b"))
    return ends.join(middle, "feature").select(
        "feature", "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("median"),
        value_of_key(F.col("low")).alias("min"), value_of_key(F.col("high")).alias("max"))


def median_map(df: DataFrame, columns: list[str]) -> Column:
    """The medians by column name, as a scalar subquery; a column without a value is not in the map."""
    table = median_table(df, columns)
    return table.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("medians")).scalar()


def exact_medians(df: DataFrame, columns: list[str], ends: dict | None = None) -> dict[str, float | None]:
    """Median of each numeric column (null without a value); ``ends`` receives (min, max)."""
    found = {r["feature"]: r for r in median_table(df, columns).collect()} if columns else {}
    if ends is not None:
        ends.update({c: (found[c]["min"], found[c]["max"]) if c in found else (None, None) for c in columns})
    return {c: found[c]["median"] if c in found else None for c in columns}
