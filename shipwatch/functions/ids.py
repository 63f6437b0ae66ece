"""Identifier builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shipwatch.fixed_values import CUSTOMER_HASH_HEX_DIGITS, CUSTOMER_HASH_PREFIX


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_identifier(c: Column | str) -> Column:
    """``cust_`` + first 16 hex digits of SHA-256 of the trimmed id text.

    A missing id hashes the text ``nan`` (what a missing value prints as in
    the original tool), so the function is total.
    """
    text = F.coalesce(F.trim(_c(c).cast("string")), F.lit("nan"))
    return F.concat(F.lit(CUSTOMER_HASH_PREFIX),
                    F.substring(F.sha2(text, 256), 1, CUSTOMER_HASH_HEX_DIGITS))


def epc(product_id, order_id, order_item_id) -> Column:
    """``EPC-<product>-<order>-<line>``."""
    return F.concat_ws("-", F.lit("EPC"), _c(product_id).cast("bigint"),
                       _c(order_id).cast("bigint"), _c(order_item_id).cast("bigint"))


def lot_id(product_id, order_month) -> Column:
    """``LOT-<product>-<yyyyMM>``."""
    return F.concat_ws("-", F.lit("LOT"), _c(product_id).cast("bigint"),
                       F.replace(_c(order_month), F.lit("-"), F.lit("")))


def shipment_id(order_id) -> Column:
    return F.concat(F.lit("SHP-"), _c(order_id).cast("bigint"))


def sensor_id(order_id) -> Column:
    """``SENSOR-`` + order id modulo 1000, zero-padded to 4 digits."""
    return F.format_string("SENSOR-%04d", F.pmod(_c(order_id).cast("bigint"), F.lit(1000)))


def lane(market, region) -> Column:
    """Sensor location text ``<market> | <region>``."""
    return F.concat_ws(" | ", _c(market), _c(region))
