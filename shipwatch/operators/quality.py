"""Data-quality report of the curation step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipwatch import fixed_values as fv
from shipwatch.functions import parse_timestamp
from shipwatch.functions.names import normalize_names
from shipwatch.operators.metrics import combine_one_row

def _is_missing(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    if dict(df.dtypes)[c] == "string":
        return col.isNull() | (col == "")
    return col.isNull()


def missing_count_columns(raw: DataFrame) -> list[Column]:
    """Aggregate expressions: row count and one missing count per column.

    Usable in ``agg`` or in ``observe`` (to collect them during another job's
    scan of the same data).
    """
    return [F.count(F.lit(1)).alias("__rows"),
            *[F.count_if(_is_missing(raw, c)).alias(f"m{i}") for i, c in enumerate(raw.columns)]]


def missing_share_from_counts(counts: DataFrame, columns: list[str],
                              top: int = fv.MISSING_SHARE_TOP) -> DataFrame:
    """(column, share) rows from a one-row table of ``missing_count_columns``."""
    return counts.select(F.inline(missing_share_array(columns, top)))


def missing_share_array(columns: list[str], top: int = fv.MISSING_SHARE_TOP) -> Column:
    """The same rows as one array of (column_name, missing_share), in their order."""
    scale = 10_000
    # ordered by the exact count (all shares have one denominator), then name
    entries = F.slice(F.array_sort(F.array(*[
        F.struct((-F.col(f"m{i}").cast("bigint")).alias("less"), F.lit(c).alias("column_name"), F.col("__rows").alias("n"))
        for i, c in enumerate(columns)])), 1, top)

    def share(e: Column) -> Column:
        n, k = F.greatest(e["n"], F.lit(1)), -e["less"] * scale
        r = F.pmod(k, n)
        q = ((k - r) / n).cast("bigint")
        up = (r * 2 > n) | ((r * 2 == n) & (F.pmod(q, F.lit(2)) == 1))
        return F.struct(e["column_name"].alias("column_name"),
                        (F.when(up, q + 1).otherwise(q) / F.lit(float(scale))).alias("missing_share"))

    return F.transform(entries, share)


def missing_share(raw: DataFrame, top: int = fv.MISSING_SHARE_TOP) -> DataFrame:
    """Share of missing values per raw column, 4 decimals, largest first.

    One aggregate computes every column's missing count in a single pass;
    the counts are then unpivoted into (column, share) rows. Empty text counts
    as missing, as an empty CSV field does. Rounding is half-to-even on the
    exact ratio, done with integer arithmetic so it is engine-independent.
    """
    return missing_share_from_counts(raw.agg(*missing_count_columns(raw)), raw.columns, top)


def date_rejects(raw: DataFrame) -> Column:
    """Aggregate expression: raw rows whose order or shipping date does not parse."""
    by_name = dict(zip(normalize_names(raw.columns, reject_collisions=False), raw.columns))
    dates = [parse_timestamp(F.col(f"`{by_name[c]}`")) for c in fv.DATE_RENAMES if c in by_name]
    bad = F.lit(False)
    for d in dates:
        bad = bad | d.isNull()
    return F.count_if(bad).alias("__bad_dates")


def raw_figures(raw: DataFrame) -> DataFrame:
    """One row with everything the report needs of the raw side: one pass."""
    return raw.agg(*missing_count_columns(raw), date_rejects(raw))


def quality_report(raw: DataFrame, clean: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """One row: raw/clean sizes, rows rejected and why, distinct orders, products
    and countries, date range and late-delivery rate. Each side is one global
    aggregate; ``figures`` (``raw_figures``) saves the raw one."""
    return _report(_raw_side(raw_figures(raw) if figures is None else figures, raw.columns), clean)


def _raw_side(figures: DataFrame, columns: list[str], *also: Column) -> DataFrame:
    return figures.select(
        F.col("__rows").alias("raw_rows"), F.lit(len(columns)).alias("raw_columns"),
        F.col("__bad_dates").alias("rejected_date_rows"), *also)


def _report(r: DataFrame, clean: DataFrame) -> DataFrame:
    c = clean.agg(F.count(F.lit(1)).alias("clean_rows"),
                  F.countDistinct("order_id").alias("unique_orders"),
                  F.countDistinct("product_id").alias("unique_products"),
                  F.countDistinct("order_country").alias("unique_countries"),
                  F.min("order_date").alias("date_min"),
                  F.max("order_date").alias("date_max"),
                  F.avg("late_delivery_risk").alias("late_delivery_risk_rate")) \
        .withColumn("clean_columns", F.lit(len(clean.columns)))
    return combine_one_row(r, c).select(
        "raw_rows", "raw_columns", "rejected_date_rows",
        (F.col("raw_rows") - F.col("rejected_date_rows") - F.col("clean_rows")).alias("rejected_incomplete_rows"),
        "clean_rows", "clean_columns", "unique_orders", "unique_products", "unique_countries", "date_min", "date_max",
        "late_delivery_risk_rate", *r.columns[3:])


def quality_document(raw: DataFrame, clean: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """The report with the missing-share map and the removed personal columns,
    shaped for a JSON document."""
    if figures is None:
        figures = raw_figures(raw)
    # one use of the figures, whose pass over the raw rows would run again for a second
    shares = F.map_from_entries(missing_share_array(raw.columns)).alias("top_missing_raw_columns_pct")
    rep = _report(_raw_side(figures, raw.columns, shares), clean)
    return rep.withColumn("sensitive_columns_removed",
                          F.array(*[F.lit(c) for c in sorted(fv.SENSITIVE_COLUMNS)]))
