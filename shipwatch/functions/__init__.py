"""Column-level functions (scalar expressions), all JVM-side built-ins."""

from shipwatch.functions.names import normalize_column_name, normalize_names
from shipwatch.functions.text import clean_text
from shipwatch.functions.parse import parse_timestamp, parse_number, parse_hour
from shipwatch.functions.ids import hash_identifier, epc, lot_id, shipment_id, sensor_id, lane
from shipwatch.functions.calendar import calendar_day, month_text, weekday_name

__all__ = [
    "normalize_column_name", "normalize_names", "clean_text", "parse_timestamp",
    "parse_number", "parse_hour", "hash_identifier", "epc", "lot_id",
    "shipment_id", "sensor_id", "lane", "calendar_day", "month_text", "weekday_name",
]
