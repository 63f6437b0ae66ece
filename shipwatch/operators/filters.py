"""Dashboard filters, filter options, semi-join lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipwatch import fixed_values as fv

Choice = list | DataFrame | None


def _membership(df: DataFrame, column: str, choice: Choice) -> tuple[DataFrame, Column | None]:
    """Restrict ``column`` to ``choice``.

    A list becomes an ``IN`` predicate (pushed into the parquet scan); a
    DataFrame of allowed values becomes a left-semi join; ``None`` keeps every
    non-null value, which is what "all options selected" means.
    """
    if choice is None:
        return df, F.col(column).isNotNull()
    if isinstance(choice, DataFrame):
        allowed = choice.select(F.col(choice.columns[0]).alias(column)).distinct()
        return df.join(allowed, column, "left_semi"), None
    if len(choice) == 0:
        return df, F.lit(False)
    return df, F.col(column).isin(list(choice))


def apply_filters(orders: DataFrame, markets: Choice = None, shipping_modes: Choice = None,
                  categories: Choice = None) -> DataFrame:
    """Conjunctive membership filter on market, shipping mode and category.

    An empty selection on any one of them yields zero rows (same schema).
    """
    conds = []
    df = orders
    for col, choice in (("market", markets), ("shipping_mode", shipping_modes),
                        ("category_name", categories)):
        df, cond = _membership(df, col, choice)
        if cond is not None:
            conds.append(cond)
    for cond in conds:
        df = df.filter(cond)
    return df


def filter_values(orders: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values of one column (an option list)."""
    return orders.select(column).na.drop().distinct().orderBy(column)


def default_categories(orders: DataFrame, n: int = fv.DEFAULT_CATEGORY_CHOICES) -> DataFrame:
    """The default category choice: the first ``n`` sorted distinct values.

    The result has at most ``n`` rows by construction, so joining it back is
    a broadcast of a bounded side.
    """
    return filter_values(orders, "category_name").limit(n)


def first_category_orders(orders: DataFrame, products: DataFrame, n: int = fv.DEFAULT_CATEGORY_CHOICES) -> DataFrame:
    """Orders under the first-``n``-categories choice, with all markets and modes.

    The choice is read from ``products`` (any table with the category names),
    not from the order lines.
    """
    return apply_filters(orders, categories=default_categories(products, n)).select(*orders.columns)


def filter_options(orders: DataFrame) -> DataFrame:
    """Every option list in one tall table: (field, value, is_default)."""
    parts = []
    for field in ("market", "shipping_mode", "category_name"):
        vals = orders.select(F.lit(field).alias("field"), F.col(field).cast("string").alias("value")) \
            .na.drop().distinct()
        parts.append(vals)
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    defaults = default_categories(orders).select(
        F.lit("category_name").alias("field"), F.col("category_name").alias("value"),
        F.lit(True).alias("d"))
    out = out.join(F.broadcast(defaults), ["field", "value"], "left")
    return out.select("field", "value",
                      F.when(F.col("field") == "category_name", F.coalesce("d", F.lit(False)))
                      .otherwise(F.lit(True)).alias("is_default"))


def stock_status_filter(inventory: DataFrame, statuses: list[str]) -> DataFrame:
    """Stock states filter; an empty choice gives no rows."""
    if len(statuses) == 0:
        return inventory.filter(F.lit(False))
    return inventory.filter(F.col("inventory_status").isin(statuses))


def readings_for_orders(readings: DataFrame, orders: DataFrame) -> DataFrame:
    """Left semi join: readings whose order is among the given orders."""
    keys = orders.select("order_id").na.drop().distinct()
    return readings.join(keys, "order_id", "left_semi")


def order_trace(reads: DataFrame, order_id: int) -> DataFrame:
    """Reads of one order in time order."""
    return reads.filter(F.col("order_id") == F.lit(order_id)).orderBy("timestamp", "event_type")


def traces_for_orders(reads: DataFrame, orders: DataFrame) -> DataFrame:
    """Reads of every order in ``orders`` (semi join)."""
    keys = orders.select("order_id").na.drop().distinct()
    return reads.join(keys, "order_id", "left_semi")
