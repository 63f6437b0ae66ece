"""Curation of the raw order export and the web access log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shipwatch import fixed_values as fv
from shipwatch.functions import (calendar_day, clean_text, hash_identifier, month_text,
                                 parse_hour, parse_number, parse_timestamp, weekday_name)
from shipwatch.operators.schema_ops import (computed_once, drop_present, normalize_columns, project,
                                            rename_present, require_columns)

INTEGER_COLUMNS = {"quantity", "late_delivery_risk", "days_shipping_real", "days_shipping_scheduled"}
LONG_COLUMNS = {"order_id", "order_item_id", "product_id", "category_id", "department_id"}


def parse_order_dates(df: DataFrame) -> DataFrame:
    """Rename the two raw date columns and parse them (bad text -> null)."""
    df = rename_present(df, fv.DATE_RENAMES)
    require_columns(df, ["order_date", "shipping_date"], "order export")
    return df.withColumns({c: parse_timestamp(c) for c in ("order_date", "shipping_date")})


def bad_date_rows(parsed: DataFrame) -> DataFrame:
    """Rows whose order or shipping date did not parse."""
    return parsed.filter(F.col("order_date").isNull() | F.col("shipping_date").isNull())


def assert_dates_parsed(parsed: DataFrame, check_empty: bool = False) -> DataFrame:
    """Fail with the row count when any date is unparsable, and, if asked, on an
    empty table (one aggregate job for both)."""
    rows, bad = parsed.agg(F.count(F.lit(1)), F.count_if(
        F.col("order_date").isNull() | F.col("shipping_date").isNull())).first()
    if check_empty and not rows:
        raise ValueError("the order export is empty")
    if bad:
        raise ValueError(f"{bad} rows have unparsable order or shipping dates")
    return parsed


def dates_checked(parsed: DataFrame) -> DataFrame:
    """Any unparsable date fails the job that reads the rows; no job of its own."""
    told = F.concat(F.lit("unparsable order or shipping date in a row of the order export (order "),
                    F.coalesce(F.col("order_id").cast("string") if "order_id" in parsed.columns else F.lit(None), F.lit("unknown")), F.lit(")"))
    return parsed.withColumns({c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(told).cast("timestamp_ntz"))
                               for c in ("order_date", "shipping_date")})


def coerce_order_numbers(df: DataFrame) -> DataFrame:
    out = {}
    for c in fv.NUMERIC_ORDER_COLUMNS:
        if c in df.columns:
            to = "int" if c in INTEGER_COLUMNS else "bigint" if c in LONG_COLUMNS else "double"
            out[c] = parse_number(c, to)
    return df.withColumns(out)


def add_order_calendar(df: DataFrame) -> DataFrame:
    """Derived day, month, weekday and delay columns."""
    return df.withColumns({
        "order_date_day": calendar_day("order_date"),
        "order_month": month_text("order_date"),
        "order_day_of_week": weekday_name("order_date"),
        "shipment_delay_delta": F.col("days_shipping_real") - F.col("days_shipping_scheduled"),
    })


def curate_orders(raw: DataFrame, on_bad_dates: str = "raise", check_empty: bool = True) -> DataFrame:
    """Raw order export (text) -> curated 30-column order-line table.

    ``on_bad_dates``: ``"raise"`` fails the run when any date is unparsable
    (with the row count) or the input is empty, in a job of its own; ``"assert"``
    checks every row in the plan itself, so the pass that writes or reads the
    table fails at the first such row; ``"drop"`` removes those rows instead
    (the quality report counts them). With the last two an empty input gives an
    empty table.
    """
    df = parse_order_dates(normalize_columns(raw))
    if on_bad_dates == "raise":
        assert_dates_parsed(df, check_empty)
    elif on_bad_dates == "assert":
        df = dates_checked(df)
    elif on_bad_dates != "drop":
        raise ValueError(f"on_bad_dates must be 'raise', 'assert' or 'drop', not {on_bad_dates!r}")
    df = rename_present(df, fv.ORDER_RENAMES)
    require_columns(df, ["customer_id"], "order export")
    df = coerce_order_numbers(df)
    df = computed_once(df, ["order_date", "shipping_date", *[c for c in fv.NUMERIC_ORDER_COLUMNS if c in df.columns]])
    if on_bad_dates == "drop":
        df = df.filter(F.col("order_date").isNotNull() & F.col("shipping_date").isNotNull())
    df = df.withColumn("customer_id_hash", hash_identifier("customer_id"))
    orders = project(df, fv.OPERATIVE_COLUMNS, "curated orders")
    orders = orders.dropna(subset=fv.REQUIRED_ORDER_COLUMNS)
    text_cols = [f.name for f in orders.schema.fields if f.dataType.simpleString() == "string"]
    orders = orders.withColumns({c: clean_text(c) for c in text_cols})
    return add_order_calendar(orders)


def web_demand(raw_logs: DataFrame) -> DataFrame:
    """Access log -> page views per day, product, category, department, hour.

    Personal columns are dropped first, rows with an unparsable date go, null
    group keys are kept. Sorted by day ascending, views descending.
    """
    logs = normalize_columns(raw_logs)
    require_columns(logs, fv.ACCESS_LOG_REQUIRED, "access log")
    logs = drop_present(logs, fv.SENSITIVE_COLUMNS)
    logs = logs.withColumn("date", parse_timestamp("date")).filter(F.col("date").isNotNull())
    logs = logs.withColumns({c: clean_text(c) for c in ("product", "category", "department", "month")})
    logs = logs.withColumns({"date_day": calendar_day("date"), "hour": parse_hour("hour")})
    return (logs.groupBy("date_day", "product", "category", "department", "hour")
            .agg(F.count(F.lit(1)).alias("page_views")))


def sort_web_demand(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("date_day").asc_nulls_last(), F.col("page_views").desc(),
                      "product", "category", "department", "hour")
