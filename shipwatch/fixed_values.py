"""Fixed values.

These names, lists and numbers must equal the ones of the system whose
results we reproduce, so they are written out plainly and together here.
Nothing else in the package hard-codes them.
"""

from __future__ import annotations

# --- fixed values: curated order table -------------------------------------
OPERATIVE_COLUMNS: list[str] = [
    "order_id", "order_item_id", "order_date", "shipping_date",
    "customer_id_hash", "customer_segment", "product_id", "product_name",
    "category_id", "category_name", "department_id", "department_name",
    "quantity", "sales", "order_item_total", "profit", "shipping_mode",
    "delivery_status", "late_delivery_risk", "order_status", "market",
    "order_region", "order_country", "order_city", "days_shipping_real",
    "days_shipping_scheduled",
]

REQUIRED_ORDER_COLUMNS: list[str] = [
    "order_id", "order_item_id", "order_date", "shipping_date", "product_id",
    "product_name", "quantity", "sales", "profit", "shipping_mode",
    "delivery_status", "late_delivery_risk", "market", "order_region",
    "order_country", "order_city", "days_shipping_real",
    "days_shipping_scheduled",
]

DERIVED_ORDER_COLUMNS: list[str] = [
    "order_date_day", "order_month", "order_day_of_week", "shipment_delay_delta",
]

SENSITIVE_COLUMNS: list[str] = [
    "customer_email", "customer_fname", "customer_lname", "customer_password",
    "customer_street", "customer_zipcode", "latitude", "longitude", "ip", "url",
]

# renames applied after snake-casing the raw order header
DATE_RENAMES: dict[str, str] = {
    "order_date_dateorders": "order_date",
    "shipping_date_dateorders": "shipping_date",
}
ORDER_RENAMES: dict[str, str] = {
    "product_card_id": "product_id",
    "order_item_quantity": "quantity",
    "order_profit_per_order": "profit",
    "days_for_shipping_real": "days_shipping_real",
    "days_for_shipment_scheduled": "days_shipping_scheduled",
}

# columns coerced to numbers during curation
NUMERIC_ORDER_COLUMNS: list[str] = [
    "order_id", "order_item_id", "product_id", "category_id", "department_id",
    "quantity", "sales", "order_item_total", "profit", "late_delivery_risk",
    "days_shipping_real", "days_shipping_scheduled",
]

ACCESS_LOG_REQUIRED: list[str] = ["product", "category", "date", "month", "hour", "department"]

MISSING_TEXT = "UNKNOWN"
CUSTOMER_HASH_PREFIX = "cust_"
CUSTOMER_HASH_HEX_DIGITS = 16

# data dictionary: privacy levels
PRIVACY_ANONYMIZED = "anonymized"
PRIVACY_OPEN = "non_sensitive"

ORDER_SAMPLE_ROWS = 50_000
RANDOM_SEED = 42

# --- fixed values: RFID milestones ------------------------------------------
MILESTONE_STAGES: list[str] = [
    "RECEIVED", "PICKED", "PACKED", "SHIPPED", "IN_TRANSIT_SCAN", "DELIVERED_OR_CLOSED",
]
MILESTONE_READERS: dict[str, str] = {
    "RECEIVED": "READER_WH_RECEIVING_01",
    "PICKED": "READER_WH_PICKING_01",
    "PACKED": "READER_PACKING_01",
    "SHIPPED": "READER_DOCK_01",
    "IN_TRANSIT_SCAN": "READER_TRANSIT_GATE_01",
    "DELIVERED_OR_CLOSED": "READER_LAST_MILE_01",
}
MILESTONE_LOCATIONS: dict[str, str] = {
    "RECEIVED": "WAREHOUSE_RECEIVING",
    "PICKED": "WAREHOUSE_PICKING",
    "PACKED": "PACKING_AREA",
    "SHIPPED": "SHIPPING_DOCK",
    "IN_TRANSIT_SCAN": "TRANSIT_NODE",
    "DELIVERED_OR_CLOSED": "LAST_MILE_OR_CLOSED",
}
# expected window of each stage, minutes relative to its anchor
PICKED_MINUTES = (15, 239)
PACKED_MINUTES = (240, 719)
IN_TRANSIT_MINUTES = (-180, 179)

# --- fixed values: IoT checkpoints -------------------------------------------
CHECKPOINTS_BY_MODE: dict[str, int] = {
    "Same Day": 2,
    "First Class": 3,
    "Second Class": 3,
    "Standard Class": 4,
}
DEFAULT_CHECKPOINTS = 3
MIN_TRANSIT_DAYS = 0.25
FALLBACK_SPAN_HOURS = 6

ALERT_RATE_BASE = 0.04
ALERT_RATE_LATE = 0.12
ALERT_RATE_STANDARD_CLASS = 0.05
ALERT_RATE_SAME_DAY = -0.02
ALERT_RATE_MIN = 0.01
ALERT_RATE_MAX = 0.35

IOT_STATES: list[str] = ["NORMAL", "TEMP_ALERT", "HUMIDITY_ALERT", "VIBRATION_ALERT", "MULTI_ALERT"]
# nominal sensor behaviour: (mean, sigma)
TEMPERATURE_NOMINAL = (22.0, 3.0)
HUMIDITY_NOMINAL = (55.0, 10.0)
VIBRATION_NOMINAL = (0.25, 0.12)
HUMIDITY_RANGE = (0.0, 100.0)

# --- fixed values: stock ------------------------------------------------------
WAREHOUSES: list[str] = ["WH_NORTH", "WH_CENTER", "WH_SOUTH", "WH_ECOMMERCE"]
SAFETY_DAYS = 3.0
SAFETY_MIN_UNITS = 5.0
WATCH_FACTOR = 1.25
ORDER_UP_FACTOR = 1.2
STOCK_STATES: list[str] = ["LOW_STOCK", "WATCH", "NORMAL"]
# ours: a product in demand that the stock table does not know
NO_STOCK_ROW = "NO_STOCK_ROW"

# --- fixed values: late-delivery model ----------------------------------------
TARGET_COLUMN = "late_delivery_risk"
CATEGORICAL_FEATURES: list[str] = [
    "shipping_mode", "market", "order_region", "order_country", "order_city",
    "customer_segment", "category_name", "department_name", "product_id",
    "order_month", "order_day_of_week",
]
NUMERICAL_FEATURES: list[str] = ["days_shipping_scheduled", "quantity", "sales"]
LEAKAGE_COLUMNS: list[str] = [
    "delivery_status", "days_shipping_real", "shipping_date", "order_status",
    "shipment_delay_delta",
]
TEST_FRACTION = 0.25
MIN_CATEGORY_FREQUENCY = 25
MAX_CATEGORY_OPTIONS = 80
MAX_ITERATIONS = 1000
DECISION_THRESHOLD = 0.5
MODEL_NAME = "late_delivery_risk_logistic_regression"
METRIC_NAMES: list[str] = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]

# --- fixed values: dashboard --------------------------------------------------
DEFAULT_CATEGORY_CHOICES = 10
TOP_REORDER_ROWS = 20
FIRST_ALERT_ROWS = 500
TOP_FEATURES = 20
PREDICTION_SAMPLE_ROWS = 500
MISSING_SHARE_TOP = 20
