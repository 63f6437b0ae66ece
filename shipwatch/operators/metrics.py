"""Grouped and global aggregates over curated orders and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shipwatch.functions.aggs import count_where, int_sum, money_sum, rate

DAILY_KEYS = ["order_date_day", "product_id", "product_name", "category_name",
              "department_name", "shipping_mode", "market", "order_region"]


def _drop_null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return df.filter(cond)


def orders_daily(orders: DataFrame) -> DataFrame:
    """Daily aggregate on 8 keys (null keys kept)."""
    return (orders.groupBy(*DAILY_KEYS)
            .agg(F.countDistinct("order_id").alias("order_count"),
                 F.count("order_item_id").alias("line_count"),
                 int_sum("quantity").alias("quantity"),
                 money_sum("sales").alias("sales"),
                 money_sum("profit").alias("profit"),
                 rate("late_delivery_risk").alias("late_delivery_rate"),
                 F.avg("days_shipping_real").alias("avg_days_shipping_real"),
                 F.avg("days_shipping_scheduled").alias("avg_days_shipping_scheduled")))


def orders_by_month(orders: DataFrame) -> DataFrame:
    """Distinct orders and sales per month (null month dropped), month order."""
    return (_drop_null_keys(orders, ["order_month"]).groupBy("order_month")
            .agg(F.countDistinct("order_id").alias("order_count"),
                 money_sum("sales").alias("sales")))


def late_risk_by_mode(orders: DataFrame) -> DataFrame:
    """Late rate and distinct orders per shipping mode; highest rate first."""
    return (_drop_null_keys(orders, ["shipping_mode"]).groupBy("shipping_mode")
            .agg(rate("late_delivery_risk").alias("late_delivery_rate"),
                 F.countDistinct("order_id").alias("order_count")))


def market_region_mode(orders: DataFrame) -> DataFrame:
    """Market x region x mode: distinct orders, sales, late rate, real days."""
    keys = ["market", "order_region", "shipping_mode"]
    return (_drop_null_keys(orders, keys).groupBy(*keys)
            .agg(F.countDistinct("order_id").alias("orders"),
                 money_sum("sales").alias("sales"),
                 rate("late_delivery_risk").alias("late_delivery_rate"),
                 F.avg("days_shipping_real").alias("avg_days_real")))


def status_counts(readings: DataFrame, status_col: str = "iot_status") -> DataFrame:
    """Readings per status (null status dropped), largest first."""
    return (_drop_null_keys(readings, [status_col]).groupBy(status_col)
            .agg(F.count(F.lit(1)).alias("events")))


def is_alert(status_col: str = "iot_status"):
    """Alert predicate: anything but NORMAL, and a missing status too."""
    return ~F.col(status_col).eqNullSafe("NORMAL")


def rfid_coverage(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count(F.lit(1)).alias("events"),
                     F.countDistinct("epc").alias("distinct_epc"),
                     F.countDistinct("order_id").alias("distinct_orders"),
                     F.countDistinct("reader_id").alias("distinct_readers"))


def iot_coverage(readings: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    alerts = count_where(is_alert())
    return (readings.agg(n.alias("events"),
                         F.countDistinct("shipment_id").alias("distinct_shipments"),
                         alerts.alias("alerts"))
            .withColumn("alert_rate", F.col("alerts") / F.greatest(F.col("events"), F.lit(1))))


def stock_summary(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count(F.lit(1)).alias("products"),
                         count_where(F.col("inventory_status") == "LOW_STOCK").alias("low_stock"),
                         count_where(F.col("inventory_status") == "WATCH").alias("watch"),
                         int_sum("stock_on_hand").alias("total_stock"))


def order_kpis(orders: DataFrame) -> DataFrame:
    """Distinct orders, sales, late rate (0 on empty input): one row."""
    return orders.agg(F.countDistinct("order_id").alias("total_orders"),
                      money_sum("sales").alias("total_sales"),
                      F.coalesce(rate("late_delivery_risk"), F.lit(0.0)).alias("late_rate"))


def combine_one_row(*parts: DataFrame) -> DataFrame:
    """Glue one-row aggregates side by side without a join.

    Each part is a single row with its own columns; they are stacked with
    missing columns as null and folded by ``first(ignorenulls)``, a global
    aggregate over as many rows as there are parts.
    """
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    cols = []
    for p in parts:
        cols += p.columns
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def kpis(filtered_orders: DataFrame, reads: DataFrame, readings: DataFrame,
         inventory: DataFrame) -> DataFrame:
    """KPI row: three figures follow the order filter, three are global.

    Each input collapses to one row first; the rows are then combined.
    """
    o = order_kpis(filtered_orders)
    r = reads.agg(F.count(F.lit(1)).alias("rfid_events"))
    i = readings.agg(count_where(is_alert()).alias("iot_alerts"))
    s = inventory.agg(count_where(F.col("inventory_status") == "LOW_STOCK").alias("low_stock"))
    return combine_one_row(o, r, i, s)


def customer_summary(orders: DataFrame) -> DataFrame:
    """Per anonymised customer: distinct orders, lines, sales."""
    return (orders.groupBy("customer_id_hash")
            .agg(F.countDistinct("order_id").alias("orders"),
                 F.count(F.lit(1)).alias("lines"),
                 money_sum("sales").alias("sales")))
