"""DuckDB SQL for the fixture tables, used by the oracle queries.

Each entry is (sql, dependencies). ``with_ctes`` assembles a WITH clause
holding exactly the CTEs a query needs, in dependency order. The SQL is an
independent spelling of ``shipwatch.sources.fixtures`` and the operators, so
agreement between the two is a real check.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (sql.strip(), deps)


cte("numbered_lines", [], """
SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
       l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
       l_linestatus) AS line_no
FROM lineitem l
""")

cte("cats", [], """
SELECT category_name, row_number() OVER (ORDER BY category_name) AS category_id
FROM (SELECT DISTINCT p_type || '-' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS category_name FROM part) t
""")

cte("staged_lines", ["numbered_lines", "cats"], """
SELECT
  l.l_orderkey AS order_id,
  l.l_orderkey * 1000003 + l.line_no AS order_item_id,
  o.o_orderdate + to_minutes(CAST(((l.l_orderkey * 37) % 1440) AS BIGINT)) AS order_date,
  CAST((((datediff('day', o.o_orderdate, l.l_shipdate)) % 7) + 7) % 7 AS INTEGER) AS days_shipping_real,
  CAST(CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2
       WHEN '4' THEN 4 WHEN '5' THEN 4 END AS INTEGER) AS days_shipping_scheduled,
  CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Same Day' WHEN '2' THEN 'First Class'
       WHEN '3' THEN 'Second Class' WHEN '4' THEN 'Standard Class' WHEN '5' THEN 'Standard Class'
  END AS shipping_mode,
  o.o_custkey AS customer_id,
  c.c_mktsegment AS customer_segment,
  p.p_partkey AS product_id,
  p.p_name AS product_name,
  cats.category_id,
  cats.category_name,
  TRY_CAST(regexp_extract(p.p_brand, '#([0-9]+)', 1) AS BIGINT) AS department_id,
  p.p_brand AS department_name,
  CAST(trunc(l.l_quantity) AS INTEGER) AS quantity,
  l.l_extendedprice AS sales,
  l.l_extendedprice * (1 - l.l_discount) AS order_item_total,
  l.l_extendedprice * (0.12 - l.l_discount) AS profit,
  o.o_orderstatus AS order_status,
  r.r_name AS market,
  n.n_name AS order_region,
  n.n_name AS order_country,
  n.n_name || '-' || CAST(c.c_custkey % 10 AS VARCHAR) AS order_city
FROM numbered_lines l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN cats ON p.p_type || '-' || lpad(CAST(p.p_size AS VARCHAR), 2, '0') = cats.category_name
""")

cte("order_lines_full", ["staged_lines"], """
SELECT
  order_id, order_item_id, order_date,
  order_date + to_days(days_shipping_real) AS shipping_date,
  'cust_' || substr(sha256(CAST(customer_id AS VARCHAR)), 1, 16) AS customer_id_hash,
  customer_id, customer_segment, product_id, product_name, category_id, category_name,
  department_id, department_name, quantity, sales, order_item_total, profit, shipping_mode,
  CASE WHEN days_shipping_real > days_shipping_scheduled THEN 'Late delivery'
       WHEN days_shipping_real = days_shipping_scheduled THEN 'Shipping on time'
       ELSE 'Advance shipping' END AS delivery_status,
  CAST(days_shipping_real > days_shipping_scheduled AS INTEGER) AS late_delivery_risk,
  order_status, market, order_region, order_country, order_city,
  days_shipping_real, days_shipping_scheduled,
  strftime(order_date, '%Y-%m-%d') AS order_date_day,
  strftime(order_date, '%Y-%m') AS order_month,
  dayname(order_date) AS order_day_of_week,
  days_shipping_real - days_shipping_scheduled AS shipment_delay_delta
FROM staged_lines
""")

cte("order_lines", ["order_lines_full"], """
SELECT * EXCLUDE (customer_id) FROM order_lines_full
""")

cte("order_starts", [], """
SELECT o_orderkey AS order_id,
       o_orderdate + to_minutes(CAST(((o_orderkey * 37) % 1440) AS BIGINT)) AS order_date,
       o_orderpriority,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Same Day' WHEN '2' THEN 'First Class'
            WHEN '3' THEN 'Second Class' WHEN '4' THEN 'Standard Class'
            WHEN '5' THEN 'Standard Class' END AS shipping_mode
FROM orders
""")

cte("rfid_reads", ["order_starts"], """
SELECT
  s.order_date + to_minutes(CAST(floor(e.value * 10) AS BIGINT)) AS "timestamp",
  e.user_id AS order_id,
  e.user_id * 1000003 + 1 AS order_item_id,
  CASE e.event_type WHEN 'signup' THEN 'RECEIVED' WHEN 'view' THEN 'PICKED'
       WHEN 'click' THEN 'PACKED' WHEN 'purchase' THEN 'SHIPPED'
       WHEN 'error' THEN 'IN_TRANSIT_SCAN' END AS event_type,
  'ANT_0' || CAST(1 + e.event_id % 4 AS VARCHAR) AS antenna_id,
  CAST(-78 + e.event_id % 44 AS INTEGER) AS rssi,
  e.event_id
FROM events e LEFT JOIN order_starts s ON e.user_id = s.order_id
""")

cte("order_risk", ["order_lines"], """
SELECT order_id, max(late_delivery_risk) AS order_risk FROM order_lines GROUP BY order_id
""")

cte("iot_readings", ["order_starts", "order_risk"], """
SELECT
  e.ts AS "timestamp",
  e.user_id AS order_id,
  e.event_id,
  round(10 + e.value / 5, 2) AS temperature_c,
  CAST((e.event_id * 7) % 131 - 10 AS DOUBLE) AS humidity_pct,
  CAST(json_extract_string(e.props, '$.k') AS DOUBLE) / 125 AS vibration_g,
  s.shipping_mode,
  CAST(coalesce(r.order_risk, 0) AS INTEGER) AS late_delivery_risk
FROM events e
LEFT JOIN order_starts s ON e.user_id = s.order_id
LEFT JOIN order_risk r ON e.user_id = r.order_id
""")

cte("stock_levels", [], """
SELECT p_partkey AS product_id,
       CAST((p_partkey * 7) % 15 AS INTEGER) AS stock_on_hand,
       CAST(3 + p_partkey % 12 AS INTEGER) AS lead_time_days
FROM part WHERE p_partkey % 41 <> 0
""")

cte("scored_lines", ["order_lines"], """
SELECT order_item_id, label, score, CAST(score > 0.5 AS INTEGER) AS prediction
FROM (
  SELECT order_item_id, late_delivery_risk AS label,
         least(CAST((order_item_id * 7919) % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE)
               + CASE WHEN shipping_mode <> 'Standard Class' THEN CAST(0.3 AS DOUBLE)
                      ELSE CAST(0.0 AS DOUBLE) END, CAST(1.0 AS DOUBLE)) AS score
  FROM order_lines) t
""")


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """WITH clause for ``names`` (and their dependencies) followed by ``body``.

    ``extra`` adds query-local CTEs, emitted after the fixture CTEs in the
    given order.
    """
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in CTES[n][1]:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS (\n{CTES[n][0]}\n)" for n in ordered]
    parts += [f"{k} AS (\n{v.strip()}\n)" for k, v in (extra or {}).items()]
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
