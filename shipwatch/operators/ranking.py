"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_ROW_BITS = 33          # monotonically_increasing_id: partition in the upper bits, row below


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add ``name`` = 1..n in ``order`` (give it a tie-break for one order of all rows).

    Rows are dealt by ranges of the order and numbered inside their partition;
    a partition's first number follows from the rows of the partitions before
    it, one count each. The ranges are sampled, so the numbered rows are
    checkpointed: both the counts and the ranks see the same partitions.
    """
    spark, at, first = df.sparkSession, "_at", "_first"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright(at, _ROW_BITS)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    table = spark.createDataFrame(offsets, f"_part bigint, {first} bigint")      # a row a partition
    inside = F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(table), part == F.col("_part")).withColumn(
        name, F.col(first) + inside + 1).select(*df.columns, name)
