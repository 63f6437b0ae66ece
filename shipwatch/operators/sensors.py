"""IoT: sensor checkpoint plan, reading classification, alert-rate gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shipwatch import fixed_values as fv
from shipwatch.functions import lane, sensor_id, shipment_id
from shipwatch.functions.rules import (channel_bounds, checkpoint_count, checkpoint_time,
                                       checkpoint_window, clamp, expected_alert_rate)
from shipwatch.operators.schema_ops import require_columns

CHECKPOINT_INPUT = ["order_id", "order_item_id", "product_id", "shipping_mode", "late_delivery_risk",
                    "days_shipping_real", "order_date", "shipping_date", "market", "order_region"]


def distinct_shipments(orders: DataFrame) -> DataFrame:
    """One row per (order, product): the line with the smallest line id.

    Deterministic, and done as a partial aggregate of ``min(struct)`` rather
    than a window, so a hot (order, product) pair is combined map-side.
    """
    rest = [c for c in orders.columns if c not in ("order_id", "product_id", "order_item_id")]
    picked = orders.groupBy("order_id", "product_id").agg(
        F.min(F.struct("order_item_id", *rest)).alias("_first"))
    return picked.select("order_id", "product_id", "_first.*").select(*orders.columns)


def checkpoint_plan(orders: DataFrame) -> DataFrame:
    """Distinct shipments -> n evenly spaced sensor checkpoints each."""
    require_columns(orders, CHECKPOINT_INPUT, "orders for checkpoint plan")
    ships = distinct_shipments(orders.select(*CHECKPOINT_INPUT))
    start, span = checkpoint_window("order_date", "shipping_date", "days_shipping_real")
    n = checkpoint_count("shipping_mode")
    staged = ships.select(
        "order_id", "product_id", "shipping_mode", "late_delivery_risk", "market", "order_region",
        start.alias("_start"), span.alias("_span"), n.alias("checkpoint_count"),
        F.explode(F.sequence(F.lit(0), n - 1)).alias("checkpoint_index"))
    return staged.select(
        checkpoint_time("_start", "_span", "checkpoint_index", "checkpoint_count").alias("timestamp"),
        shipment_id("order_id").alias("shipment_id"),
        "order_id", "product_id",
        sensor_id("order_id").alias("sensor_id"),
        lane("market", "order_region").alias("location"),
        "shipping_mode", "late_delivery_risk",
        "checkpoint_index", "checkpoint_count",
        expected_alert_rate("late_delivery_risk", "shipping_mode").alias("expected_alert_rate"))


def _outside(c: Column, bounds: tuple[float, float]) -> Column:
    return F.coalesce((c < F.lit(bounds[0])) | (c > F.lit(bounds[1])), F.lit(False))


def classify_readings(readings: DataFrame, k: float = 3.0) -> DataFrame:
    """State of each reading from per-channel limits (mean +/- k sigma).

    Humidity is clamped to 0..100 and vibration to >= 0 first. One channel out
    of range gives that channel's alert, two or more MULTI_ALERT, none NORMAL.
    A missing channel value never raises an alert by itself.
    """
    require_columns(readings, ["temperature_c", "humidity_pct", "vibration_g"], "readings")
    t = F.col("temperature_c")
    h = clamp(F.col("humidity_pct"), *fv.HUMIDITY_RANGE)
    v = clamp(F.col("vibration_g"), 0.0)
    flags = {
        "TEMP_ALERT": _outside(t, channel_bounds(fv.TEMPERATURE_NOMINAL, k)),
        "HUMIDITY_ALERT": _outside(h, channel_bounds(fv.HUMIDITY_NOMINAL, k)),
        "VIBRATION_ALERT": _outside(v, channel_bounds(fv.VIBRATION_NOMINAL, k)),
    }
    n = sum((f.cast("int") for f in flags.values()), F.lit(0))
    status = F.when(n >= 2, F.lit("MULTI_ALERT"))
    for name, f in flags.items():
        status = status.when(f, F.lit(name))
    status = status.otherwise(F.lit("NORMAL"))
    return readings.withColumns({"humidity_pct": h, "vibration_g": v,
                                 "alert_channels": n, "iot_status": status})


def with_shipment_ids(readings: DataFrame) -> DataFrame:
    return readings.withColumns({"shipment_id": shipment_id("order_id"),
                                 "sensor_id": sensor_id("order_id")})


def alerts(classified: DataFrame) -> DataFrame:
    """Alerting readings (a missing status counts as an alert)."""
    return classified.filter(~F.col("iot_status").eqNullSafe("NORMAL"))


def alert_rate_gap(classified: DataFrame) -> DataFrame:
    """Observed alert share against the expected rate per mode and late risk."""
    keys = ["shipping_mode", "late_delivery_risk"]
    obs = (classified.filter(F.col("shipping_mode").isNotNull() & F.col("late_delivery_risk").isNotNull())
           .groupBy(*keys)
           .agg(F.count(F.lit(1)).alias("readings"),
                F.avg((~F.col("iot_status").eqNullSafe("NORMAL")).cast("int")).alias("observed_alert_rate")))
    return (obs.withColumn("expected_alert_rate", expected_alert_rate("late_delivery_risk", "shipping_mode"))
            .withColumn("alert_rate_gap", F.col("observed_alert_rate") - F.col("expected_alert_rate")))
