"""Business rules as column expressions (milestones, checkpoints, stock).

Time arithmetic is done in whole microseconds on zone-less timestamps, so the
results do not depend on the session time zone.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from shipwatch import fixed_values as fv

MICROS_PER_MINUTE = 60 * 1_000_000
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def add_micros(ts, micros) -> Column:
    return F.timestamp_add("MICROSECOND", _c(micros).cast("bigint"), _c(ts))


def add_minutes(ts, minutes) -> Column:
    return F.timestamp_add("MINUTE", _c(minutes).cast("bigint"), _c(ts))


def diff_micros(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def transit_micros(days_real, floor_days: float = 0.0) -> Column:
    """max(days_real, floor_days) expressed in microseconds (integral)."""
    floor_us = int(Decimal(str(floor_days)) * MICROS_PER_DAY)
    return F.greatest(_c(days_real).cast("bigint") * F.lit(MICROS_PER_DAY), F.lit(floor_us))


def estimated_delivery(order_date, days_real) -> Column:
    """order date + max(real days, 0)."""
    return add_micros(order_date, transit_micros(days_real, 0.0))


def closing_time(order_date, shipping_date, days_real) -> Column:
    """Later of the shipping date and the estimated delivery."""
    return F.greatest(_c(shipping_date), estimated_delivery(order_date, days_real))


def transit_midpoint(order_date, days_real) -> Column:
    """Midpoint between the order date and the estimated delivery."""
    return add_micros(order_date, F.floor(transit_micros(days_real, 0.0) / 2))


def checkpoint_count(shipping_mode) -> Column:
    """Sensor checkpoints per shipping mode; unknown modes get the default."""
    pairs = []
    for mode, n in fv.CHECKPOINTS_BY_MODE.items():
        pairs += [F.lit(mode), F.lit(n)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(shipping_mode)),
                      F.lit(fv.DEFAULT_CHECKPOINTS))


def checkpoint_window(order_date, shipping_date, days_real) -> tuple[Column, Column]:
    """(start, span in micros) of the sensor checkpoints of one shipment.

    Start is the shipping date; the end is order date + max(real days, 0.25);
    when that end is not after the start, the span is 6 hours.
    """
    start = _c(shipping_date)
    end = add_micros(order_date, transit_micros(days_real, fv.MIN_TRANSIT_DAYS))
    span = F.when(end <= start, F.lit(fv.FALLBACK_SPAN_HOURS * MICROS_PER_HOUR)) \
        .otherwise(diff_micros(start, end))
    return start, span


def checkpoint_time(start, span_micros, index, count) -> Column:
    """Evenly spaced checkpoint ``index`` of ``count`` over [start, start+span]."""
    step = F.floor(_c(span_micros) * _c(index) / F.greatest(_c(count) - 1, F.lit(1)))
    return F.when(_c(count) <= 1, _c(start)).otherwise(add_micros(start, step))


def expected_alert_rate(late_delivery_risk, shipping_mode) -> Column:
    """Expected share of alerting readings for a shipment (decimal-exact)."""
    rate = (F.lit(Decimal(str(fv.ALERT_RATE_BASE)))
            + F.when(_c(late_delivery_risk) == 1, F.lit(Decimal(str(fv.ALERT_RATE_LATE))))
               .otherwise(F.lit(Decimal("0")))
            + F.when(_c(shipping_mode) == "Standard Class",
                     F.lit(Decimal(str(fv.ALERT_RATE_STANDARD_CLASS))))
               .when(_c(shipping_mode) == "Same Day", F.lit(Decimal(str(fv.ALERT_RATE_SAME_DAY))))
               .otherwise(F.lit(Decimal("0"))))
    clamped = F.least(F.greatest(rate, F.lit(Decimal(str(fv.ALERT_RATE_MIN)))),
                      F.lit(Decimal(str(fv.ALERT_RATE_MAX))))
    return clamped.cast("double")


def warehouse_for(product_id) -> Column:
    """Warehouse from product id modulo the number of warehouses."""
    arr = F.array(*[F.lit(w) for w in fv.WAREHOUSES])
    return F.element_at(arr, (F.pmod(_c(product_id).cast("bigint"), F.lit(len(fv.WAREHOUSES))) + 1).cast("int"))


def stock_status(stock_on_hand, reorder_point) -> Column:
    """LOW_STOCK at or under the reorder point, WATCH up to 1.25x, else NORMAL."""
    s, r = _c(stock_on_hand), _c(reorder_point)
    return (F.when(s <= r, F.lit("LOW_STOCK"))
            .when(s <= r * F.lit(fv.WATCH_FACTOR), F.lit("WATCH"))
            .otherwise(F.lit("NORMAL")))


def safety_stock(avg_daily_demand) -> Column:
    return F.greatest(_c(avg_daily_demand) * F.lit(fv.SAFETY_DAYS), F.lit(fv.SAFETY_MIN_UNITS))


def reorder_point(avg_daily_demand, lead_time_days) -> Column:
    return _c(avg_daily_demand) * _c(lead_time_days) + safety_stock(avg_daily_demand)


def order_quantity(avg_daily_demand, lead_time_days, stock_on_hand) -> Column:
    """int(max(1.2 x demand x lead + safety - stock, 0)), truncating."""
    target = (_c(avg_daily_demand) * _c(lead_time_days) * F.lit(fv.ORDER_UP_FACTOR)
              + safety_stock(avg_daily_demand))
    return F.greatest(target - _c(stock_on_hand), F.lit(0.0)).cast("int")


def clamp(c, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp into [lo, hi]; a null stays null (greatest/least skip nulls)."""
    src = _c(c)
    out = src
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(src.isNull(), F.lit(None)).otherwise(out)


def channel_bounds(nominal: tuple[float, float], k: float) -> tuple[float, float]:
    """mean -/+ k sigma, computed in decimal so the bounds are the intended literals."""
    mean, sigma = Decimal(str(nominal[0])), Decimal(str(nominal[1]))
    kk = Decimal(str(k))
    return float(mean - kk * sigma), float(mean + kk * sigma)
