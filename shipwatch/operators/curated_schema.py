"""The curated order-line table as a schema whose fields describe themselves.

``about`` says what a column holds, ``step`` which side of the curation makes
it (the export itself, or curation), ``privacy`` how personal it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampNTZType)

from shipwatch import fixed_values as fv

EXPORT, CURATION = "export", "curation"


def _field(name: str, kind, about: str, step: str = EXPORT, privacy: str = fv.PRIVACY_OPEN) -> StructField:
    return StructField(name, kind, True, {"about": about, "step": step, "privacy": privacy})


_LONG, _INT, _DOUBLE, _TEXT, _TIME = LongType(), IntegerType(), DoubleType(), StringType(), TimestampNTZType()

CURATED = StructType([
    _field("order_id", _LONG, "Number of the order; its lines share it"),
    _field("order_item_id", _LONG, "Number of the line, unique in the table"),
    _field("order_date", _TIME, "When the customer ordered (wall clock)"),
    _field("shipping_date", _TIME, "When the goods left (wall clock)"),
    _field("customer_id_hash", _TEXT, "Stable pseudonym of the customer: shortened hash of the customer number",
           CURATION, fv.PRIVACY_ANONYMIZED),
    _field("customer_segment", _TEXT, "Kind of customer"),
    _field("product_id", _LONG, "Number of the product; stock and demand are kept per product"),
    _field("product_name", _TEXT, "What the product is called"),
    _field("category_id", _LONG, "Number of the product's category"),
    _field("category_name", _TEXT, "What the category is called"),
    _field("department_id", _LONG, "Number of the selling department"),
    _field("department_name", _TEXT, "What the department is called"),
    _field("quantity", _INT, "Pieces on the line"),
    _field("sales", _DOUBLE, "Value of the line before discount"),
    _field("order_item_total", _DOUBLE, "Value of the line after discount"),
    _field("profit", _DOUBLE, "Gain on the line, negative for a loss"),
    _field("shipping_mode", _TEXT, "Service level that was booked"),
    _field("delivery_status", _TEXT, "How the delivery went against its schedule"),
    _field("late_delivery_risk", _INT, "1 if the delivery came late, else 0: what the model predicts"),
    _field("order_status", _TEXT, "Where the order stands"),
    _field("market", _TEXT, "Part of the world that is served"),
    _field("order_region", _TEXT, "Region the goods go to"),
    _field("order_country", _TEXT, "Country the goods go to"),
    _field("order_city", _TEXT, "City the goods go to"),
    _field("days_shipping_real", _INT, "Days the delivery took"),
    _field("days_shipping_scheduled", _INT, "Days the delivery was meant to take"),
    _field("order_date_day", _TEXT, "Day of the order date, yyyy-MM-dd", CURATION),
    _field("order_month", _TEXT, "Month of the order date, yyyy-MM", CURATION),
    _field("order_day_of_week", _TEXT, "English weekday of the order date", CURATION),
    _field("shipment_delay_delta", _INT, "Days taken minus days planned; positive means late", CURATION),
])


def data_dictionary(spark: SparkSession, schema: StructType = CURATED) -> DataFrame:
    """One row per column of a described schema: name, description, source, privacy level."""
    rows = [(f.name, f.metadata["about"], f.metadata["step"], f.metadata["privacy"]) for f in schema.fields]
    return spark.createDataFrame(rows, "column_name string, description string, source string, privacy_level string")
