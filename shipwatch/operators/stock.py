"""Demand per product and replenishment (stock states, reorder quantities)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shipwatch import fixed_values as fv
from shipwatch.functions.rules import (order_quantity, reorder_point, safety_stock,
                                       stock_status, warehouse_for)
from shipwatch.operators.schema_ops import require_columns

PRODUCT_KEYS = ["product_id", "product_name", "category_name", "department_name"]


def product_daily_demand(daily: DataFrame) -> DataFrame:
    """Quantity per product and day (null keys kept)."""
    require_columns(daily, ["order_date_day", *PRODUCT_KEYS, "quantity"], "daily aggregate")
    return daily.groupBy("order_date_day", *PRODUCT_KEYS) \
        .agg(F.sum("quantity").cast("bigint").alias("quantity"))


def product_demand(daily: DataFrame) -> DataFrame:
    """Total, active days, peak day and average daily demand per product.

    The average over all calendar days uses the number of distinct days in
    the whole table (at least 1), computed once as a scalar subquery.
    """
    pd_ = product_daily_demand(daily)
    calendar_days = pd_.agg(F.greatest(F.countDistinct("order_date_day"), F.lit(1))
                            .alias("d")).scalar()
    demand = pd_.groupBy(*PRODUCT_KEYS).agg(
        F.sum("quantity").cast("bigint").alias("total_quantity"),
        F.countDistinct("order_date_day").alias("active_days"),
        F.max("quantity").cast("bigint").alias("max_daily_demand"))
    return demand.withColumns({
        "calendar_days": calendar_days.cast("bigint"),
        "avg_daily_demand": F.col("total_quantity") / calendar_days,
        "avg_active_day_demand": F.col("total_quantity") / F.greatest(F.col("active_days"), F.lit(1)),
    })


def replenishment(demand: DataFrame, stock: DataFrame) -> DataFrame:
    """Demand joined to on-hand stock and lead time -> reorder quantities and states.

    ``stock`` has one row per product (``product_id, stock_on_hand,
    lead_time_days``); the equi join is 1:1 on the product id. A product with
    demand but no stock row stays, with the state ``NO_STOCK_ROW`` and no
    quantities that would need one.
    """
    require_columns(stock, ["product_id", "stock_on_hand", "lead_time_days"], "stock table")
    j = demand.join(stock.select("product_id", "stock_on_hand", "lead_time_days"), "product_id", "left")
    d, lead, s = F.col("avg_daily_demand"), F.col("lead_time_days"), F.col("stock_on_hand")
    rop = reorder_point(d, lead)
    return j.select(
        "product_id", "product_name", "category_name", "department_name",
        warehouse_for("product_id").alias("warehouse_id"),
        s.cast("int").alias("stock_on_hand"),
        F.bround(d, 4).alias("avg_daily_demand"),
        F.bround(F.col("avg_active_day_demand"), 4).alias("avg_active_day_demand"),
        lead.cast("int").alias("lead_time_days"),
        F.bround(safety_stock(d), 0).cast("int").alias("safety_stock"),
        F.bround(rop, 0).cast("int").alias("reorder_point"),
        F.when(s.isNotNull() & lead.isNotNull(), order_quantity(d, lead, s)).alias("recommended_order_qty"),
        F.when(s.isNull() | lead.isNull(), F.lit(fv.NO_STOCK_ROW)).otherwise(stock_status(s, rop))
        .alias("inventory_status"))


def sort_replenishment(inv: DataFrame) -> DataFrame:
    return inv.orderBy("inventory_status", F.desc("recommended_order_qty"), "product_id")


def top_reorder(inv: DataFrame, n: int = 20) -> DataFrame:
    """Largest recommended quantities first (product id breaks ties)."""
    return inv.orderBy(F.desc_nulls_last("recommended_order_qty"), "product_id").limit(n)
