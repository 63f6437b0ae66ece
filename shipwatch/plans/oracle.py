"""DuckDB oracle SQL for every named query that SQL can express."""

from __future__ import annotations

from shipwatch import fixed_values as fv
from shipwatch.plans.oracle_fixtures import with_ctes

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


MONEY = "DECIMAL(38,6)"


def money_sum(col: str) -> str:
    return f"CAST(coalesce(sum(CAST({col} AS {MONEY})), 0) AS DOUBLE)"


CURATED_COLUMNS = """order_id, order_item_id, order_date, shipping_date, customer_id_hash,
  customer_segment, product_id, product_name, category_id, category_name, department_id,
  department_name, quantity, sales, order_item_total, profit, shipping_mode, delivery_status,
  late_delivery_risk, order_status, market, order_region, order_country, order_city,
  days_shipping_real, days_shipping_scheduled, order_date_day, order_month, order_day_of_week,
  shipment_delay_delta"""

# curated from the dirty export: bad-date orders and empty-sales lines are
# gone, blank segments read UNKNOWN
CURATED_FROM_RAW = f"""
SELECT * REPLACE (CASE WHEN order_item_id % 89 = 0 THEN 'UNKNOWN' ELSE customer_segment END
                  AS customer_segment)
FROM (SELECT {CURATED_COLUMNS} FROM order_lines) t
WHERE order_id % 97 <> 0 AND order_item_id % 83 <> 0
"""

oracle("curated_orders", with_ctes(CURATED_FROM_RAW, "order_lines"))

oracle("anonymised_customers", with_ctes(f"""
SELECT customer_id_hash, count(DISTINCT order_id) AS orders, count(*) AS lines,
       {money_sum('sales')} AS sales
FROM curated GROUP BY customer_id_hash
""", "order_lines", extra={"curated": CURATED_FROM_RAW}))

oracle("rejects_bad_dates", with_ctes("""
SELECT order_id, order_item_id FROM order_lines WHERE order_id % 97 = 0
""", "order_lines"))

oracle("orders_filtered", with_ctes(f"""
SELECT {CURATED_COLUMNS} FROM order_lines
WHERE market IS NOT NULL AND shipping_mode IS NOT NULL
  AND category_name IN (SELECT category_name FROM cats ORDER BY 1 LIMIT 10)
""", "order_lines"))

oracle("orders_filtered_all", with_ctes(f"""
SELECT {CURATED_COLUMNS} FROM order_lines
WHERE market IS NOT NULL AND shipping_mode IS NOT NULL AND category_name IS NOT NULL
""", "order_lines"))

oracle("orders_filtered_choice", with_ctes(f"""
SELECT {CURATED_COLUMNS} FROM order_lines
WHERE market IN ('ASIA', 'EUROPE') AND shipping_mode IN ('Same Day', 'First Class') AND category_name IS NOT NULL
""", "order_lines"))

oracle("orders_filtered_empty", with_ctes(f"""
SELECT {CURATED_COLUMNS} FROM order_lines WHERE false
""", "order_lines"))

oracle("filter_options", with_ctes("""
SELECT field, value, CASE WHEN field = 'category_name'
                          THEN value IN (SELECT v FROM defaults) ELSE true END AS is_default
FROM (
  SELECT DISTINCT 'market' AS field, market AS value FROM order_lines WHERE market IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'shipping_mode', shipping_mode FROM order_lines WHERE shipping_mode IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'category_name', category_name FROM order_lines WHERE category_name IS NOT NULL
) t
""", "order_lines", extra={"defaults": """
SELECT DISTINCT category_name AS v FROM order_lines WHERE category_name IS NOT NULL
ORDER BY 1 LIMIT 10"""}))

oracle("orders_daily", with_ctes(f"""
SELECT order_date_day, product_id, product_name, category_name, department_name,
       shipping_mode, market, order_region,
       count(DISTINCT order_id) AS order_count,
       count(order_item_id) AS line_count,
       CAST(sum(quantity) AS BIGINT) AS quantity,
       {money_sum('sales')} AS sales,
       {money_sum('profit')} AS profit,
       avg(late_delivery_risk) AS late_delivery_rate,
       avg(days_shipping_real) AS avg_days_shipping_real,
       avg(days_shipping_scheduled) AS avg_days_shipping_scheduled
FROM order_lines
GROUP BY ALL
""", "order_lines"))

oracle("orders_by_month", with_ctes(f"""
SELECT order_month, count(DISTINCT order_id) AS order_count, {money_sum('sales')} AS sales
FROM order_lines WHERE order_month IS NOT NULL GROUP BY order_month ORDER BY order_month
""", "order_lines"))

oracle("late_risk_by_mode", with_ctes("""
SELECT shipping_mode, avg(late_delivery_risk) AS late_delivery_rate,
       count(DISTINCT order_id) AS order_count
FROM order_lines WHERE shipping_mode IS NOT NULL GROUP BY shipping_mode
ORDER BY late_delivery_rate DESC, shipping_mode
""", "order_lines"))

oracle("market_region_mode", with_ctes(f"""
SELECT market, order_region, shipping_mode,
       count(DISTINCT order_id) AS orders,
       {money_sum('sales')} AS sales,
       avg(late_delivery_risk) AS late_delivery_rate,
       avg(days_shipping_real) AS avg_days_real
FROM order_lines
WHERE market IS NOT NULL AND order_region IS NOT NULL AND shipping_mode IS NOT NULL
GROUP BY market, order_region, shipping_mode
ORDER BY late_delivery_rate DESC, market, order_region, shipping_mode
""", "order_lines"))


# ---- shared SQL blocks for steps 4-7 -------------------------------------------------

ALL_FILTERED = f"""
SELECT {CURATED_COLUMNS} FROM order_lines
WHERE market IS NOT NULL AND shipping_mode IS NOT NULL AND category_name IS NOT NULL
"""

ORDERS_DAILY = f"""
SELECT order_date_day, product_id, product_name, category_name, department_name,
       shipping_mode, market, order_region,
       count(DISTINCT order_id) AS order_count,
       count(order_item_id) AS line_count,
       CAST(sum(quantity) AS BIGINT) AS quantity,
       {money_sum('sales')} AS sales,
       {money_sum('profit')} AS profit,
       avg(late_delivery_risk) AS late_delivery_rate,
       avg(days_shipping_real) AS avg_days_shipping_real,
       avg(days_shipping_scheduled) AS avg_days_shipping_scheduled
FROM order_lines
GROUP BY ALL
"""

PRODUCT_DAILY = """
SELECT order_date_day, product_id, product_name, category_name, department_name,
       CAST(sum(quantity) AS BIGINT) AS quantity
FROM daily GROUP BY ALL
"""

DEMAND = """
SELECT product_id, product_name, category_name, department_name,
       CAST(sum(quantity) AS BIGINT) AS total_quantity,
       count(DISTINCT order_date_day) AS active_days,
       CAST(max(quantity) AS BIGINT) AS max_daily_demand,
       (SELECT greatest(count(DISTINCT order_date_day), 1) FROM product_daily) AS calendar_days,
       sum(quantity) / (SELECT greatest(count(DISTINCT order_date_day), 1) FROM product_daily)
         AS avg_daily_demand,
       sum(quantity) / greatest(count(DISTINCT order_date_day), 1) AS avg_active_day_demand
FROM product_daily GROUP BY product_id, product_name, category_name, department_name
"""

INVENTORY = """
SELECT product_id, product_name, category_name, department_name,
       ['WH_NORTH', 'WH_CENTER', 'WH_SOUTH', 'WH_ECOMMERCE'][(product_id % 4) + 1] AS warehouse_id,
       stock_on_hand,
       round_even(avg_daily_demand, 4) AS avg_daily_demand,
       round_even(avg_active_day_demand, 4) AS avg_active_day_demand,
       lead_time_days,
       CAST(round_even(safety, 0) AS INTEGER) AS safety_stock,
       CAST(round_even(rop, 0) AS INTEGER) AS reorder_point,
       CASE WHEN stock_on_hand IS NOT NULL THEN
       CAST(trunc(greatest(avg_daily_demand * lead_time_days * 1.2 + safety - stock_on_hand, 0.0))
            AS INTEGER) END AS recommended_order_qty,
       CASE WHEN stock_on_hand IS NULL THEN 'NO_STOCK_ROW' WHEN stock_on_hand <= rop THEN 'LOW_STOCK'
            WHEN stock_on_hand <= rop * 1.25 THEN 'WATCH' ELSE 'NORMAL' END AS inventory_status
FROM (
  SELECT d.*, s.stock_on_hand, s.lead_time_days,
         greatest(d.avg_daily_demand * 3.0, 5.0) AS safety,
         d.avg_daily_demand * s.lead_time_days + greatest(d.avg_daily_demand * 3.0, 5.0) AS rop
  FROM demand d LEFT JOIN stock_levels s ON d.product_id = s.product_id) t
"""

INVENTORY_CTES = {"daily": ORDERS_DAILY, "product_daily": PRODUCT_DAILY, "demand": DEMAND,
                  "inventory": INVENTORY}

CLASSIFIED = """
SELECT "timestamp", order_id, event_id, temperature_c, humidity_pct, vibration_g,
       shipping_mode, late_delivery_risk, shipment_id, sensor_id, alert_channels,
       CASE WHEN alert_channels >= 2 THEN 'MULTI_ALERT'
            WHEN ft THEN 'TEMP_ALERT' WHEN fh THEN 'HUMIDITY_ALERT'
            WHEN fv THEN 'VIBRATION_ALERT' ELSE 'NORMAL' END AS iot_status
FROM (
  SELECT *, CAST(ft AS INTEGER) + CAST(fh AS INTEGER) + CAST(fv AS INTEGER) AS alert_channels
  FROM (
    SELECT "timestamp", order_id, event_id, temperature_c, h AS humidity_pct, v AS vibration_g,
           shipping_mode, late_delivery_risk,
           'SHP-' || CAST(order_id AS VARCHAR) AS shipment_id,
           'SENSOR-' || lpad(CAST(order_id % 1000 AS VARCHAR), 4, '0') AS sensor_id,
           coalesce(temperature_c < 13.0 OR temperature_c > 31.0, false) AS ft,
           coalesce(h < 25.0 OR h > 85.0, false) AS fh,
           coalesce(v < -0.11 OR v > 0.61, false) AS fv
    FROM (SELECT *, least(greatest(humidity_pct, 0.0), 100.0) AS h,
                 greatest(vibration_g, 0.0) AS v FROM iot_readings) r
  ) a
) b
"""

ALERT_RATE = """CAST(least(greatest(0.04 + CASE WHEN late_delivery_risk = 1 THEN 0.12 ELSE 0.00 END
     + CASE shipping_mode WHEN 'Standard Class' THEN 0.05 WHEN 'Same Day' THEN -0.02 ELSE 0.00 END,
     0.01), 0.35) AS DOUBLE)"""

MILESTONE_PLAN = """
SELECT order_id, order_item_id, product_id, product_name,
       'EPC-' || CAST(product_id AS VARCHAR) || '-' || CAST(order_id AS VARCHAR) || '-'
         || CAST(order_item_id AS VARCHAR) AS epc,
       'LOT-' || CAST(product_id AS VARCHAR) || '-' || replace(order_month, '-', '') AS lot_id,
       s.stage_seq, s.event_type, s.reader_id, s.location,
       CASE s.event_type
         WHEN 'RECEIVED' THEN order_date
         WHEN 'PICKED' THEN order_date + INTERVAL 15 MINUTE
         WHEN 'PACKED' THEN order_date + INTERVAL 240 MINUTE
         WHEN 'SHIPPED' THEN shipping_date
         WHEN 'IN_TRANSIT_SCAN' THEN mid - INTERVAL 180 MINUTE
         ELSE closing END AS expected_start,
       CASE s.event_type
         WHEN 'RECEIVED' THEN order_date
         WHEN 'PICKED' THEN order_date + INTERVAL 239 MINUTE
         WHEN 'PACKED' THEN order_date + INTERVAL 719 MINUTE
         WHEN 'SHIPPED' THEN shipping_date
         WHEN 'IN_TRANSIT_SCAN' THEN mid + INTERVAL 179 MINUTE
         ELSE closing END AS expected_end
FROM (
  SELECT *,
    order_date + to_microseconds(CAST(floor(greatest(days_shipping_real, 0) * 86400000000 / 2) AS BIGINT)) AS mid,
    greatest(shipping_date,
             order_date + to_microseconds(greatest(days_shipping_real, 0) * 86400000000)) AS closing
  FROM order_lines) o
CROSS JOIN (VALUES
  (1, 'RECEIVED', 'READER_WH_RECEIVING_01', 'WAREHOUSE_RECEIVING'),
  (2, 'PICKED', 'READER_WH_PICKING_01', 'WAREHOUSE_PICKING'),
  (3, 'PACKED', 'READER_PACKING_01', 'PACKING_AREA'),
  (4, 'SHIPPED', 'READER_DOCK_01', 'SHIPPING_DOCK'),
  (5, 'IN_TRANSIT_SCAN', 'READER_TRANSIT_GATE_01', 'TRANSIT_NODE'),
  (6, 'DELIVERED_OR_CLOSED', 'READER_LAST_MILE_01', 'LAST_MILE_OR_CLOSED')
) s(stage_seq, event_type, reader_id, location)
"""

ENRICHED_READS = """
SELECT r."timestamp",
       CASE WHEN l.product_id IS NOT NULL THEN 'EPC-' || CAST(l.product_id AS VARCHAR) || '-'
            || CAST(r.order_id AS VARCHAR) || '-' || CAST(r.order_item_id AS VARCHAR) END AS epc,
       r.order_id, r.order_item_id, l.product_id, l.product_name,
       CASE WHEN l.product_id IS NOT NULL THEN 'LOT-' || CAST(l.product_id AS VARCHAR) || '-'
            || replace(l.order_month, '-', '') END AS lot_id,
       CASE r.event_type WHEN 'RECEIVED' THEN 'READER_WH_RECEIVING_01'
            WHEN 'PICKED' THEN 'READER_WH_PICKING_01' WHEN 'PACKED' THEN 'READER_PACKING_01'
            WHEN 'SHIPPED' THEN 'READER_DOCK_01' WHEN 'IN_TRANSIT_SCAN' THEN 'READER_TRANSIT_GATE_01'
            WHEN 'DELIVERED_OR_CLOSED' THEN 'READER_LAST_MILE_01' END AS reader_id,
       r.antenna_id, r.event_type,
       CASE r.event_type WHEN 'RECEIVED' THEN 'WAREHOUSE_RECEIVING'
            WHEN 'PICKED' THEN 'WAREHOUSE_PICKING' WHEN 'PACKED' THEN 'PACKING_AREA'
            WHEN 'SHIPPED' THEN 'SHIPPING_DOCK' WHEN 'IN_TRANSIT_SCAN' THEN 'TRANSIT_NODE'
            WHEN 'DELIVERED_OR_CLOSED' THEN 'LAST_MILE_OR_CLOSED' END AS location,
       r.rssi
FROM rfid_reads r LEFT JOIN order_lines l ON r.order_id = l.order_id AND r.order_item_id = l.order_item_id
"""

FIRST_SHIPMENTS = f"""
SELECT {CURATED_COLUMNS} FROM order_lines
QUALIFY row_number() OVER (PARTITION BY order_id, product_id ORDER BY order_item_id) = 1
"""

# ---- step 4 -----------------------------------------------------------------------------

oracle("orders_sample", with_ctes(f"""
SELECT {CURATED_COLUMNS} FROM order_lines
ORDER BY md5('42-' || CAST(order_item_id AS VARCHAR)) LIMIT 50000
""", "order_lines"))

oracle("shipments_distinct", with_ctes(FIRST_SHIPMENTS, "order_lines"))

oracle("top_reorder", with_ctes("""
SELECT * FROM inventory ORDER BY recommended_order_qty DESC NULLS LAST, product_id LIMIT 20
""", "order_lines", "stock_levels", extra=INVENTORY_CTES))

oracle("first_alerts", with_ctes("""
SELECT * FROM classified WHERE iot_status IS DISTINCT FROM 'NORMAL'
ORDER BY "timestamp", order_id, event_id LIMIT 500
""", "iot_readings", extra={"classified": CLASSIFIED}))

# ---- step 5 -----------------------------------------------------------------------------

oracle("milestone_plan", with_ctes(MILESTONE_PLAN, "order_lines"))

oracle("milestone_conformance", with_ctes("""
SELECT coalesce(p.order_id, r.read_order_id) AS order_id,
       coalesce(p.order_item_id, r.order_item_id) AS order_item_id,
       coalesce(p.event_type, r.event_type) AS event_type,
       p.expected_start, p.expected_end, r.first_read,
       coalesce(r.read_count, 0) AS read_count,
       CASE WHEN p.expected_start IS NULL THEN 'UNPLANNED'
            WHEN r.first_read IS NULL THEN 'MISSING'
            WHEN r.first_read < p.expected_start - INTERVAL 60 MINUTE THEN 'EARLY'
            WHEN r.first_read > p.expected_end + INTERVAL 60 MINUTE THEN 'LATE'
            ELSE 'IN_WINDOW' END AS conformance
FROM plan p FULL OUTER JOIN first_reads r
  ON p.order_item_id = r.order_item_id AND p.event_type = r.event_type
""", "order_lines", "rfid_reads", extra={
    "plan": MILESTONE_PLAN,
    "first_reads": """SELECT order_item_id, event_type, min("timestamp") AS first_read,
                      count(*) AS read_count, min(order_id) AS read_order_id
                      FROM rfid_reads GROUP BY order_item_id, event_type"""}))

oracle("order_trace", with_ctes("""
SELECT * FROM enriched WHERE order_id = (SELECT min(order_id) FROM filtered)
ORDER BY "timestamp", event_type
""", "order_lines", "rfid_reads", extra={"filtered": ALL_FILTERED, "enriched": ENRICHED_READS}))

oracle("traces_for_orders", with_ctes("""
SELECT * FROM enriched WHERE order_id IN (SELECT order_id FROM order_lines WHERE market = 'ASIA'
  AND shipping_mode IS NOT NULL AND category_name IS NOT NULL)
""", "order_lines", "rfid_reads", extra={"enriched": ENRICHED_READS}))

oracle("rfid_coverage", with_ctes("""
SELECT count(*) AS events, count(DISTINCT epc) AS distinct_epc,
       count(DISTINCT order_id) AS distinct_orders, count(DISTINCT reader_id) AS distinct_readers
FROM enriched
""", "order_lines", "rfid_reads", extra={"enriched": ENRICHED_READS}))

# ---- step 6 -----------------------------------------------------------------------------

oracle("checkpoint_plan", with_ctes(f"""
SELECT CASE WHEN checkpoint_count <= 1 THEN st
            ELSE st + to_microseconds(CAST(floor(CAST(span * checkpoint_index AS DOUBLE)
                                              / greatest(checkpoint_count - 1, 1)) AS BIGINT))
       END AS "timestamp",
       'SHP-' || CAST(order_id AS VARCHAR) AS shipment_id,
       order_id, product_id,
       'SENSOR-' || lpad(CAST(order_id % 1000 AS VARCHAR), 4, '0') AS sensor_id,
       market || ' | ' || order_region AS location,
       shipping_mode, late_delivery_risk, checkpoint_index, checkpoint_count,
       {ALERT_RATE} AS expected_alert_rate
FROM (
  SELECT *, CAST(unnest(range(0, checkpoint_count)) AS INTEGER) AS checkpoint_index
  FROM (
    SELECT *, CASE WHEN en <= st THEN CAST(21600000000 AS BIGINT)
                   ELSE date_diff('microsecond', st, en) END AS span
    FROM (
      SELECT order_id, product_id, shipping_mode, late_delivery_risk, market, order_region,
             shipping_date AS st,
             order_date + to_microseconds(greatest(CAST(days_shipping_real AS BIGINT) * 86400000000,
                                                   21600000000)) AS en,
             CAST(CASE shipping_mode WHEN 'Same Day' THEN 2 WHEN 'First Class' THEN 3
                  WHEN 'Second Class' THEN 3 WHEN 'Standard Class' THEN 4 ELSE 3 END AS INTEGER)
               AS checkpoint_count
      FROM ships) a) b) c
""", "order_lines", extra={"ships": FIRST_SHIPMENTS}))

oracle("classified_readings", with_ctes("SELECT * FROM classified", "iot_readings",
                                        extra={"classified": CLASSIFIED}))

oracle("iot_status_summary", with_ctes("""
SELECT iot_status, count(*) AS events FROM classified WHERE iot_status IS NOT NULL
GROUP BY iot_status ORDER BY events DESC, iot_status
""", "iot_readings", extra={"classified": CLASSIFIED}))

oracle("iot_alerts_for_orders", with_ctes("""
SELECT * FROM classified
WHERE order_id IN (SELECT order_id FROM filtered) AND iot_status IS DISTINCT FROM 'NORMAL'
""", "iot_readings", "order_lines", extra={"classified": CLASSIFIED, "filtered": ALL_FILTERED}))

STANDARD_ORDERS = """
SELECT order_id FROM order_lines WHERE shipping_mode = 'Standard Class' AND market IS NOT NULL AND category_name IS NOT NULL
"""

oracle("iot_status_for_orders", with_ctes("""
SELECT iot_status, count(*) AS events FROM classified
WHERE iot_status IS NOT NULL AND order_id IN (SELECT order_id FROM chosen) GROUP BY iot_status
""", "iot_readings", "order_lines", extra={"classified": CLASSIFIED, "chosen": STANDARD_ORDERS}))

oracle("first_alerts_for_orders", with_ctes("""
SELECT * FROM classified
WHERE iot_status IS DISTINCT FROM 'NORMAL' AND order_id IN (SELECT order_id FROM chosen)
ORDER BY "timestamp", order_id, event_id LIMIT 500
""", "iot_readings", "order_lines", extra={"classified": CLASSIFIED, "chosen": STANDARD_ORDERS}))

oracle("alert_rate_gap", with_ctes(f"""
SELECT shipping_mode, late_delivery_risk, readings, observed_alert_rate,
       {ALERT_RATE} AS expected_alert_rate,
       observed_alert_rate - {ALERT_RATE} AS alert_rate_gap
FROM (
  SELECT shipping_mode, late_delivery_risk, count(*) AS readings,
         avg(CAST(iot_status IS DISTINCT FROM 'NORMAL' AS INTEGER)) AS observed_alert_rate
  FROM classified WHERE shipping_mode IS NOT NULL AND late_delivery_risk IS NOT NULL
  GROUP BY shipping_mode, late_delivery_risk) t
ORDER BY shipping_mode, late_delivery_risk
""", "iot_readings", extra={"classified": CLASSIFIED}))

oracle("iot_coverage", with_ctes("""
SELECT events, distinct_shipments, alerts, alerts / greatest(events, 1) AS alert_rate
FROM (SELECT count(*) AS events, count(DISTINCT shipment_id) AS distinct_shipments,
             CAST(count_if(iot_status IS DISTINCT FROM 'NORMAL') AS BIGINT) AS alerts
      FROM classified) t
""", "iot_readings", extra={"classified": CLASSIFIED}))

# ---- step 7 -----------------------------------------------------------------------------

oracle("product_demand", with_ctes("SELECT * FROM demand", "order_lines",
                                   extra={"daily": ORDERS_DAILY, "product_daily": PRODUCT_DAILY,
                                          "demand": DEMAND}))

oracle("replenishment", with_ctes("""
SELECT * FROM inventory ORDER BY inventory_status, recommended_order_qty DESC, product_id
""", "order_lines", "stock_levels", extra=INVENTORY_CTES))

oracle("stock_by_state", with_ctes("""
SELECT * FROM inventory WHERE inventory_status IN ('LOW_STOCK', 'NO_STOCK_ROW')
""", "order_lines", "stock_levels", extra=INVENTORY_CTES))

oracle("stock_summary", with_ctes("""
SELECT count(*) AS products,
       CAST(count_if(inventory_status = 'LOW_STOCK') AS BIGINT) AS low_stock,
       CAST(count_if(inventory_status = 'WATCH') AS BIGINT) AS watch,
       CAST(coalesce(sum(stock_on_hand), 0) AS BIGINT) AS total_stock
FROM inventory
""", "order_lines", "stock_levels", extra=INVENTORY_CTES))

oracle("kpis", with_ctes(f"""
SELECT (SELECT count(DISTINCT order_id) FROM filtered) AS total_orders,
       (SELECT {money_sum('sales')} FROM filtered) AS total_sales,
       (SELECT coalesce(avg(late_delivery_risk), 0.0) FROM filtered) AS late_rate,
       (SELECT count(*) FROM rfid_reads) AS rfid_events,
       (SELECT CAST(count_if(iot_status IS DISTINCT FROM 'NORMAL') AS BIGINT) FROM classified)
         AS iot_alerts,
       (SELECT CAST(count_if(inventory_status = 'LOW_STOCK') AS BIGINT) FROM inventory) AS low_stock
""", "order_lines", "stock_levels", "rfid_reads", "iot_readings",
    extra={"filtered": ALL_FILTERED, "classified": CLASSIFIED, **INVENTORY_CTES}))


# ---- step 8 -----------------------------------------------------------------------------

CATS = ["shipping_mode", "market", "order_region", "order_country", "order_city",
        "customer_segment", "category_name", "department_name", "product_id",
        "order_month", "order_day_of_week"]
NUMS = ["days_shipping_scheduled", "quantity", "sales"]


def _clean(c: str) -> str:
    t = f"regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {c} IS NULL OR {t} = '' THEN 'UNKNOWN' ELSE {t} END"


MODEL_LINES = """(SELECT * REPLACE (CASE WHEN order_item_id % 79 <> 0 THEN quantity END AS quantity) FROM order_lines)"""

MODEL_FRAME = ("SELECT order_item_id, "
               + ", ".join(f"{_clean(c)} AS {c}" for c in CATS) + ", "
               + ", ".join(f"coalesce(TRY_CAST({c} AS DOUBLE), "
                           f"(SELECT coalesce(median(TRY_CAST({c} AS DOUBLE)), 0.0) FROM {MODEL_LINES})) AS {c}"
                           for c in NUMS)
               + f", CAST(late_delivery_risk AS INTEGER) AS late_delivery_risk FROM {MODEL_LINES}")

SPLIT = """
SELECT m.*, CASE WHEN rn <= q.quota THEN 'test' ELSE 'train' END AS split
FROM (SELECT *,
        row_number() OVER (PARTITION BY late_delivery_risk
                           ORDER BY md5('42-' || CAST(order_item_id AS VARCHAR))) AS rn
      FROM model_frame) m
JOIN quotas q ON m.late_delivery_risk = q.late_delivery_risk
"""

QUOTAS = """
SELECT late_delivery_risk,
       base + CASE WHEN row_number() OVER (ORDER BY rem DESC, late_delivery_risk)
                        <= total - sum(base) OVER () THEN 1 ELSE 0 END AS quota
FROM (SELECT late_delivery_risk, total, (total * n_c) // n AS base, (total * n_c) % n AS rem
      FROM (SELECT late_delivery_risk, n_c, sum(n_c) OVER () AS n,
                   (sum(n_c) OVER () * 1 + 4 - 1) // 4 AS total
            FROM (SELECT late_delivery_risk, count(*) AS n_c FROM model_frame
                  GROUP BY late_delivery_risk) c) a) b
"""

oracle("model_frame", with_ctes(MODEL_FRAME, "order_lines"))

oracle("stratified_split", with_ctes("SELECT order_item_id, late_delivery_risk, split FROM split",
                                     "order_lines", extra={"model_frame": MODEL_FRAME, "quotas": QUOTAS, "split": SPLIT}))

oracle("category_vocabulary", with_ctes("""
SELECT feature, value, frequency, position, position = 1 AS is_default
FROM (SELECT feature, value, frequency,
             CAST(row_number() OVER (PARTITION BY feature ORDER BY frequency DESC, value) AS INTEGER)
               AS position
      FROM (SELECT feature, value, count(*) AS frequency FROM tall
            WHERE value IS NOT NULL GROUP BY feature, value) c) r
WHERE position <= 80
""", "order_lines", extra={"model_frame": MODEL_FRAME, "tall": "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM model_frame" for c in CATS)}))

oracle("numeric_profile", with_ctes("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, median(CAST({c} AS DOUBLE)) AS median, "
    f"min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max FROM model_frame"
    for c in NUMS), "order_lines", extra={"model_frame": MODEL_FRAME}))

oracle("class_balance", with_ctes("""
SELECT split, rows, pos / rows AS positive_rate FROM (
  SELECT split, count(*) AS rows, sum(late_delivery_risk) AS pos FROM split GROUP BY split
  UNION ALL
  SELECT 'total', count(*), sum(late_delivery_risk) FROM split) t
""", "order_lines", extra={"model_frame": MODEL_FRAME, "quotas": QUOTAS, "split": SPLIT}))

TRAIN = {"model_frame": MODEL_FRAME, "quotas": QUOTAS, "split": SPLIT,
         "train": "SELECT * FROM split WHERE split = 'train'"}
TALL_TRAIN = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM train" for c in CATS)

oracle("encoder_slots", with_ctes("""
SELECT feature, value, n, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS slot
FROM counts WHERE n >= 25
UNION ALL
SELECT f.feature, NULL, CAST(coalesce(sum(n) FILTER (WHERE n < 25), 0) AS BIGINT),
       CAST(coalesce(count(n) FILTER (WHERE n >= 25), 0) AS INTEGER)
FROM (SELECT DISTINCT feature FROM counts) f JOIN counts USING (feature) GROUP BY f.feature
""", "order_lines", extra=TRAIN | {"tall": TALL_TRAIN, "counts": "SELECT feature, value, count(*) AS n FROM tall GROUP BY ALL"}))

SLOTS = """
SELECT feature, value, n, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS slot
FROM counts WHERE n >= 25
UNION ALL
SELECT feature, NULL, CAST(coalesce(sum(n) FILTER (WHERE n < 25), 0) AS BIGINT), CAST(count(n) FILTER (WHERE n >= 25) AS INTEGER)
FROM counts GROUP BY feature
"""
ENCODER = TRAIN | {"tall": TALL_TRAIN, "counts": "SELECT feature, value, count(*) AS n FROM tall GROUP BY ALL", "slots": SLOTS}
CAT_LIST = "[" + ", ".join(f"'{c}'" for c in CATS) + "]"

oracle("encoded_rows", with_ctes(f"""
SELECT order_item_id, array_to_string(list_sort(list(CAST(f.first + coalesce(s.slot, r.slot) AS INTEGER))), ',') AS slots
FROM everything t
LEFT JOIN slots s ON s.feature = t.feature AND s.value = t.value
JOIN slots r ON r.feature = t.feature AND r.value IS NULL
JOIN (SELECT feature, coalesce(sum(width) OVER (ORDER BY list_position({CAT_LIST}, feature) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
      FROM (SELECT feature, max(slot) + 1 AS width FROM slots GROUP BY feature) w) f ON f.feature = t.feature
GROUP BY order_item_id
""", "order_lines", extra=ENCODER | {"everything": "\nUNION ALL\n".join(
    f"SELECT order_item_id, '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM model_frame" for c in CATS)}))

SHARE_TERMS = {
    "late": "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, sum(late_delivery_risk) AS late, count(*) AS n FROM train GROUP BY {c}" for c in CATS),
    "terms": """
SELECT feature, value, late / n - 0.5::DOUBLE AS coefficient FROM late WHERE n >= 25
UNION ALL
SELECT feature, NULL, coalesce(sum(late) FILTER (WHERE n < 25) / sum(n) FILTER (WHERE n < 25) - 0.5::DOUBLE, 0.0) FROM late GROUP BY feature""",
    "figures": "SELECT sum(late_delivery_risk) / count(*) - 0.5::DOUBLE AS intercept, " + ", ".join(
        f"CAST(sum(CAST({c} AS DECIMAL(38,6))) AS DOUBLE) / count(*) AS {c}__mean, "
        f"CAST(sum(CAST({c} AS DECIMAL(38,6))) FILTER (WHERE late_delivery_risk = 1) AS DOUBLE) / sum(late_delivery_risk) AS {c}__late, "
        f"max({c}) - min({c}) AS {c}__range" for c in NUMS) + " FROM train"}


def by_terms(rows: str, columns: str, at_least: str) -> str:
    """The sparse dot product over ``rows`` (with a column ``part`` that tells them apart)."""
    joins = "\n".join(f"LEFT JOIN terms t{k} ON t{k}.feature = '{c}' AND t{k}.value = x.{c}" for k, c in enumerate(CATS))
    rare = ", ".join(f"max(coefficient) FILTER (WHERE feature = '{c}' AND value IS NULL) AS {c}__rare" for c in CATS)
    total = "f.intercept" + "".join(f" + coalesce(t{k}.coefficient, r.{c}__rare)" for k, c in enumerate(CATS)) + "".join(
        f" + (f.{c}__late - f.{c}__mean) / f.{c}__range * ((x.{c} - f.{c}__mean) / f.{c}__range)" for c in NUMS)
    return f"""
SELECT {columns}, p, CAST(p {at_least} 0.5 AS INTEGER) AS class
FROM (SELECT x.*, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({total}))) AS p
      FROM {rows} x {joins}, figures f, (SELECT {rare} FROM terms) r) y
"""


oracle("term_scores", with_ctes(f"""
SELECT order_item_id, round(p, 9) AS probability, class AS late_delivery_risk_pred
FROM ({by_terms("(SELECT * FROM split WHERE split = 'test')", "order_item_id", ">")}) s
""", "order_lines", extra=TRAIN | SHARE_TERMS))

oracle("scaler_constants", with_ctes("\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END, 6) "
    f"AS deviation FROM train" for c in NUMS), "order_lines", extra=TRAIN))

oracle("class_weights", with_ctes("""
SELECT late_delivery_risk, count(*) AS rows, (SELECT count(*) FROM train) / (2 * count(*)) AS class_weight
FROM train GROUP BY late_delivery_risk
""", "order_lines", extra=TRAIN))

oracle("run_counts", with_ctes("""
SELECT count(*) AS total_rows, CAST(count_if(split = 'train') AS BIGINT) AS train_rows,
       CAST(count_if(split = 'test') AS BIGINT) AS test_rows, avg(late_delivery_risk) AS positive_class_rate_total,
       avg(late_delivery_risk) FILTER (WHERE split = 'train') AS positive_class_rate_train,
       avg(late_delivery_risk) FILTER (WHERE split = 'test') AS positive_class_rate_test
FROM split
""", "order_lines", extra=TRAIN))

SCENARIOS = """
SELECT DISTINCT CASE WHEN shipping_mode <> 'Same Day' THEN shipping_mode END AS shipping_mode, market, order_city,
       CASE market WHEN 'ASIA' THEN 'nan' WHEN 'AFRICA' THEN 'soon' ELSE CAST(days_shipping_scheduled AS VARCHAR) END
         AS days_shipping_scheduled
FROM (SELECT DISTINCT shipping_mode, market, days_shipping_scheduled, order_city FROM order_lines) t
"""
# shipping mode and scheduled days go together, so the lanes stay distinct

oracle("filled_scenarios", with_ctes("SELECT " + ", ".join(
    f"coalesce({c}, 'UNKNOWN') AS {c}" if c in ("shipping_mode", "market", "order_city") else f"'UNKNOWN' AS {c}" for c in CATS)
    + """, coalesce(CASE WHEN days_shipping_scheduled <> 'nan' THEN TRY_CAST(days_shipping_scheduled AS DOUBLE) END, 0.0)
       AS days_shipping_scheduled, CAST(0.0 AS DOUBLE) AS quantity, CAST(0.0 AS DOUBLE) AS sales
FROM scenarios
""", "order_lines", extra={"scenarios": SCENARIOS}))

FILLED = "SELECT " + ", ".join(
    f"coalesce({c}, 'UNKNOWN') AS {c}" if c in ("shipping_mode", "market", "order_city") else f"'UNKNOWN' AS {c}" for c in CATS) + """,
       coalesce(CASE WHEN days_shipping_scheduled <> 'nan' THEN TRY_CAST(days_shipping_scheduled AS DOUBLE) END, 0.0) AS days_shipping_scheduled,
       CAST(0.0 AS DOUBLE) AS quantity, CAST(0.0 AS DOUBLE) AS sales, shipping_mode AS given_mode, days_shipping_scheduled AS given_days
FROM scenarios"""

oracle("term_scenario_scores", with_ctes(f"""
SELECT given_mode AS shipping_mode, market, order_city, given_days AS days_shipping_scheduled,
       round(p, 9) AS late_delivery_risk_probability, class AS late_delivery_risk_class
FROM ({by_terms("filled", "given_mode, market, order_city, given_days", ">=")}) s
""", "order_lines", extra=TRAIN | SHARE_TERMS | {"scenarios": SCENARIOS, "filled": FILLED}))

oracle("lines_by_profit", with_ctes("""
SELECT order_item_id, profit, row_number() OVER (ORDER BY profit DESC NULLS LAST, order_item_id) AS rank FROM order_lines
""", "order_lines"))

COEFFICIENTS = """
SELECT category_name AS feature, sum(late_delivery_risk) / count(*) - 0.5::DOUBLE AS coefficient
FROM order_lines GROUP BY category_name
"""
RANKED = """
SELECT CAST(row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS INTEGER) AS rank, feature, coefficient,
       abs(coefficient) AS abs_importance FROM coefficients
"""

oracle("ranked_importance", with_ctes(RANKED, "order_lines", extra={"coefficients": COEFFICIENTS}))

oracle("top_features", with_ctes("SELECT * FROM ranked ORDER BY abs_importance DESC, feature LIMIT 20", "order_lines",
                                 extra={"coefficients": COEFFICIENTS, "ranked": RANKED}))

oracle("feature_schema", with_ctes(f"""
SELECT 'late_delivery_risk' AS target_column, '{",".join(CATS)}' AS categorical_features,
       '{",".join(NUMS)}' AS numerical_features,
       (SELECT string_agg(shipping_mode, ',' ORDER BY n DESC, shipping_mode)
        FROM (SELECT shipping_mode, count(*) AS n FROM model_frame GROUP BY shipping_mode) t) AS shipping_modes,
       (SELECT CAST(least(count(DISTINCT category_name), 80) AS INTEGER) FROM model_frame) AS category_options,
       (SELECT market FROM model_frame GROUP BY market ORDER BY count(*) DESC, market LIMIT 1) AS default_market,
       median(quantity) AS default_quantity, min(sales) AS least_sales, max(sales) AS largest_sales
FROM model_frame
""", "order_lines", extra={"model_frame": MODEL_FRAME}))

oracle("classification_metrics", with_ctes("""
SELECT tn, fp, fn, tp,
       CASE WHEN tn + fp + fn + tp = 0 THEN 0.0 ELSE (tp + tn) / (tn + fp + fn + tp) END AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1_score
FROM (SELECT CAST(count_if(label = 0 AND prediction = 0) AS BIGINT) AS tn,
             CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS fp,
             CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS fn,
             CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS tp FROM scored_lines) c
""", "scored_lines"))

oracle("confusion_matrix", with_ctes("""
SELECT l.label, coalesce(c.pred_0, 0) AS pred_0, coalesce(c.pred_1, 0) AS pred_1
FROM (VALUES (0), (1)) l(label)
LEFT JOIN (SELECT label, CAST(count_if(prediction = 0) AS BIGINT) AS pred_0,
                  CAST(count_if(prediction = 1) AS BIGINT) AS pred_1
           FROM scored_lines GROUP BY label) c ON l.label = c.label
""", "scored_lines"))

oracle("roc_auc", with_ctes("""
SELECT CASE WHEN sum(p) * sum(n) = 0 THEN NULL
            ELSE CAST(sum(n * (2 * above + p)) AS DOUBLE) / CAST(2 * sum(p) * sum(n) AS DOUBLE) END
         AS roc_auc,
       CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives
FROM (SELECT s, p, n, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING
                                            AND 1 PRECEDING), 0) AS above
      FROM (SELECT score AS s, count_if(label = 1) AS p, count_if(label = 0) AS n
            FROM scored_lines GROUP BY score) g) t
""", "scored_lines"))


# ---- step 11: streams, as the batch result over closed windows ---------------------------

oracle("stream_alerts", with_ctes("""
SELECT * FROM classified WHERE iot_status IS DISTINCT FROM 'NORMAL'
""", "iot_readings", extra={"classified": CLASSIFIED}))

oracle("stream_status_counts", with_ctes("""
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, iot_status, count(*) AS events
FROM (SELECT time_bucket(INTERVAL 1 HOUR, "timestamp") AS window_start, iot_status FROM classified) t
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE
GROUP BY window_start, iot_status
""", "iot_readings", extra={"classified": CLASSIFIED}))


# ---- step 3 -----------------------------------------------------------------------------

def _clean_sql(c: str) -> str:
    t = f"regexp_replace(CAST({c} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {c} IS NULL OR {t} IN ('', 'nan') THEN 'UNKNOWN' ELSE {t} END"


oracle("web_demand", """
SELECT date_day, product, category, department, hour, count(*) AS page_views
FROM (
  SELECT strftime(e.ts, '%Y-%m-%d') AS date_day,
         """ + _clean_sql("p.p_name") + """ AS product,
         """ + _clean_sql("p.p_type") + """ AS category,
         """ + _clean_sql("p.p_brand") + """ AS department,
         CASE WHEN e.event_id % 50 = 0 THEN -1 ELSE CAST(hour(e.ts) AS INTEGER) END AS hour
  FROM events e LEFT JOIN part p ON e.event_id % (SELECT max(p_partkey) + 1 FROM part) = p.p_partkey
  WHERE e.event_id % 61 <> 0) t
GROUP BY date_day, product, category, department, hour
ORDER BY date_day, page_views DESC, product, category, department, hour
""")

RAW_MISSING = {"Sales": "count_if(order_item_id % 83 = 0)"}
RAW_NAMES = ["Order Id", "Order Item Id", "order date (DateOrders)", "shipping date (DateOrders)",
             "Customer Id", "Customer Segment", "Product Card Id", "Product Name", "Category Id",
             "Category Name", "Department Id", "Department Name", "Order Item Quantity", "Sales",
             "Order Item Total", "Order Profit Per Order", "Shipping Mode", "Delivery Status",
             "Late_delivery_risk", "Order Status", "Market", "Order Region", "Order Country",
             "Order City", "Days for shipping (real)", "Days for shipment (scheduled)",
             "Customer Email", "Customer Fname", "Customer Lname", "Customer Password",
             "Customer Street", "Customer Zipcode", "Latitude", "Longitude"]

MISSING_SHARE = """
SELECT column_name,
       (CASE WHEN 2 * r > n OR (2 * r = n AND q % 2 = 1) THEN q + 1 ELSE q END) / 10000.0 AS missing_share
FROM (SELECT column_name, k, n, (k * 10000) // n AS q, k * 10000 - ((k * 10000) // n) * n AS r
      FROM (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST({RAW_MISSING.get(c, '0')} AS BIGINT) AS k, "
    f"count(*) AS n FROM order_lines" for c in RAW_NAMES) + """) u) t
ORDER BY k DESC, column_name LIMIT 20
"""

oracle("missing_share", with_ctes(MISSING_SHARE, "order_lines"))

QUALITY_REPORT = """
SELECT (SELECT count(*) FROM order_lines) AS raw_rows, 34 AS raw_columns,
       (SELECT count(*) FROM order_lines WHERE order_id % 97 = 0) AS rejected_date_rows,
       (SELECT count(*) FROM order_lines WHERE order_id % 97 <> 0 AND order_item_id % 83 = 0) AS rejected_incomplete_rows,
       count(*) AS clean_rows, 30 AS clean_columns,
       count(DISTINCT order_id) AS unique_orders, count(DISTINCT product_id) AS unique_products,
       count(DISTINCT order_country) AS unique_countries,
       min(order_date) AS date_min, max(order_date) AS date_max,
       avg(late_delivery_risk) AS late_delivery_risk_rate
FROM curated
"""

oracle("quality_report", with_ctes(QUALITY_REPORT, "order_lines", extra={"curated": CURATED_FROM_RAW}))

oracle("quality_document", with_ctes(f"""
SELECT report.*,
       (SELECT string_agg(column_name || '=' || printf('%.4f', missing_share), ';' ORDER BY column_name) FROM shares)
         AS top_missing_raw_columns_pct,
       '{";".join(sorted(fv.SENSITIVE_COLUMNS))}' AS sensitive_columns_removed
FROM report
""", "order_lines", extra={"curated": CURATED_FROM_RAW, "report": QUALITY_REPORT, "shares": MISSING_SHARE}))

oracle("metrics_table", with_ctes("""
SELECT metric, value, printf('%.2f', value * 100) || '%' AS value_percent
FROM (
  SELECT 'accuracy' AS metric, accuracy AS value FROM m UNION ALL
  SELECT 'precision', precision FROM m UNION ALL
  SELECT 'recall', recall FROM m UNION ALL
  SELECT 'f1_score', f1_score FROM m UNION ALL
  SELECT 'roc_auc', roc_auc FROM a) t
""", "scored_lines", extra={
    "m": """
SELECT CASE WHEN tn + fp + fn + tp = 0 THEN 0.0 ELSE (tp + tn) / (tn + fp + fn + tp) END AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1_score
FROM (SELECT count_if(label = 0 AND prediction = 0) AS tn, count_if(label = 0 AND prediction = 1) AS fp,
             count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 1 AND prediction = 1) AS tp
      FROM scored_lines) c""",
    "a": """
SELECT CAST(sum(n * (2 * above + p)) AS DOUBLE) / CAST(2 * sum(p) * sum(n) AS DOUBLE) AS roc_auc
FROM (SELECT s, p, n, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING
                                            AND 1 PRECEDING), 0) AS above
      FROM (SELECT score AS s, count_if(label = 1) AS p, count_if(label = 0) AS n
            FROM scored_lines GROUP BY score) g) t"""}))

oracle("export_lines", with_ctes("""
SELECT order_item_id, CASE WHEN order_item_id % 101 > 1 THEN 'ru\u00e9-' || order_item_id END AS street,
       order_item_id % 101 > 1 AND order_item_id % 83 <> 0 AS has_sales,
       CASE order_item_id % 101 WHEN 0 THEN 5 WHEN 1 THEN 36 ELSE 34 END AS fields,
       CASE order_item_id % 101 WHEN 0 THEN 'too few fields' WHEN 1 THEN 'too many fields' END AS reason
FROM order_lines
""", "order_lines"))
