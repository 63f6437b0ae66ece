"""Mapping of the star-schema test tables onto the logistics tables.

The test data has no logistics tables, so each one is derived from the
TPC-H-like tables by a fixed rule (see FIXTURES.md section 2). Every rule is
a plain DataFrame expression, so the derived tables are lazy plans that scale
with their inputs; nothing is materialised on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shipwatch.functions import calendar_day, hash_identifier, month_text, weekday_name
from shipwatch.functions.rules import add_minutes
from shipwatch.sources.tables import read_table

# mode rules keyed by the first character of the order priority:
# (shipping mode, scheduled days)
PRIORITY_MODES: dict[str, tuple[str, int]] = {
    "1": ("Same Day", 0),
    "2": ("First Class", 1),
    "3": ("Second Class", 2),
    "4": ("Standard Class", 4),
    "5": ("Standard Class", 4),
}

EVENT_STAGES: dict[str, str] = {
    "signup": "RECEIVED",
    "view": "PICKED",
    "click": "PACKED",
    "purchase": "SHIPPED",
    "error": "IN_TRANSIT_SCAN",
}

# line id = order id * LINE_SPAN + line number: ids cannot meet while an order has
# fewer lines; odd, so that remainders of the ids vary with the order too
LINE_SPAN = 1_000_003

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

# every table and column that the order lines are made of
LINE_INPUTS: dict[str, list[str]] = {
    "lineitem": ["l_orderkey", *LINE_ORDER],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
}
# to be changed with the rule by which they are made: stored results name it
LINE_RULE = "order lines 1"


def _priority_mode(priority: F.Column) -> tuple[F.Column, F.Column]:
    key = F.substring(priority, 1, 1)
    mode = sched = None
    for k, (m, d) in PRIORITY_MODES.items():
        mode = (F.when(key == k, F.lit(m)) if mode is None else mode.when(key == k, F.lit(m)))
        sched = (F.when(key == k, F.lit(d)) if sched is None else sched.when(key == k, F.lit(d)))
    return mode, sched


def dimension_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation joined to region: 25 rows by the schema's definition."""
    nation, region = (read_table(spark, sf_dir, t, *LINE_INPUTS[t]) for t in ("nation", "region"))
    # region is a fixed five-row dimension: broadcasting it is size-safe
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey) \
        .select("n_nationkey", "n_name", "r_name")


def product_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> product, category and department ids and names."""
    part = read_table(spark, sf_dir, "part", *LINE_INPUTS["part"]) \
        .withColumn("category_name", F.concat_ws("-", "p_type", F.format_string("%02d", F.col("p_size"))))
    # category id = position of the category in the sorted list of distinct ones
    # (type and size: 300 at most); the window runs over these, never over part rows
    categories = part.select("category_name").distinct() \
        .withColumn("category_id", F.row_number().over(Window.orderBy("category_name")).cast("bigint"))
    return (part.join(categories, "category_name")
            .select(F.col("p_partkey").alias("product_id"),
                    F.col("p_name").alias("product_name"),
                    "category_id",
                    "category_name",
                    F.regexp_extract("p_brand", r"#(\d+)", 1).try_cast("bigint").alias("department_id"),
                    F.col("p_brand").alias("department_name")))


def line_inputs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The tables that ``order_lines`` reads, with the columns it reads."""
    return [read_table(spark, sf_dir, t, *columns) for t, columns in LINE_INPUTS.items()]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated order-line table (30 columns) built from the test tables."""
    return _order_lines(spark, sf_dir).drop("customer_id")


def _order_lines(spark: SparkSession, sf_dir: str, opaque: bool = False) -> DataFrame:
    """Order lines with the plain customer id.

    ``opaque`` numbers the lines after the joins instead of before: the
    window then stops predicate pushdown, so the table behaves like the raw
    file it stands in for (predicates over text parsed from it are evaluated
    once above it, not copied into its join conditions).
    """
    li, orders, customer = (read_table(spark, sf_dir, t, *LINE_INPUTS[t]) for t in ("lineitem", "orders", "customer"))
    geo = dimension_geo(spark, sf_dir)

    # customer and geography ride on the orders side first (a join of
    # orders-sized inputs; nation/region is a fixed 25-row dimension, so
    # broadcasting it is size-safe) ...
    cust = customer.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey)
    orders = orders.join(cust, orders.o_custkey == cust.c_custkey)
    # ... and the lines are numbered within their order on the line table
    # alone: the join on the order key then reuses the window's partitioning
    # (line-sized data is exchanged only on the order and part keys), and
    # filters on order-side columns (market, mode, ...) can be pushed below
    # the join into the dimension scans, which they could not be through a
    # window sitting above it
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    if not opaque:
        li = li.withColumn("line_no", F.row_number().over(w))
    products = product_dimension(spark, sf_dir)
    if opaque:
        # the order key last: the window needs no further exchange of the joined rows
        lines = li.join(products, li.l_partkey == F.col("product_id")).join(orders, li.l_orderkey == orders.o_orderkey)
        lines = lines.withColumn("line_no", F.row_number().over(w))
    else:
        lines = li.join(orders, li.l_orderkey == orders.o_orderkey)
        lines = lines.join(products, lines.l_partkey == F.col("product_id"))

    mode, sched = _priority_mode(F.col("o_orderpriority"))
    order_date = add_minutes("o_orderdate", F.pmod(F.col("l_orderkey") * 37, F.lit(1440)))
    real = F.pmod(F.datediff(F.col("l_shipdate"), F.col("o_orderdate")), F.lit(7))

    staged = lines.select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_orderkey") * LINE_SPAN + F.col("line_no")).alias("order_item_id"),
        order_date.alias("order_date"),
        real.cast("int").alias("days_shipping_real"),
        sched.cast("int").alias("days_shipping_scheduled"),
        mode.alias("shipping_mode"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("customer_segment"),
        "product_id", "product_name", "category_id", "category_name",
        "department_id", "department_name",
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("sales"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("order_item_total"),
        (F.col("l_extendedprice") * (F.lit(0.12).cast("decimal(2,2)") - F.col("l_discount")))
        .alias("profit"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("r_name").alias("market"),
        F.col("n_name").alias("order_region"),
        F.col("n_name").alias("order_country"),
        F.concat(F.col("n_name"), F.lit("-"), F.pmod(F.col("c_custkey"), F.lit(10))).alias("order_city"),
    )
    late = F.col("days_shipping_real") > F.col("days_shipping_scheduled")
    delta = F.col("days_shipping_real") - F.col("days_shipping_scheduled")
    return staged.select(
        "order_id", "order_item_id", "order_date",
        F.timestamp_add("DAY", F.col("days_shipping_real"), F.col("order_date")).alias("shipping_date"),
        hash_identifier("customer_id").alias("customer_id_hash"),
        "customer_id", "customer_segment", "product_id", "product_name", "category_id", "category_name",
        "department_id", "department_name", "quantity", "sales", "order_item_total", "profit",
        "shipping_mode",
        F.when(delta > 0, "Late delivery").when(delta == 0, "Shipping on time")
        .otherwise("Advance shipping").alias("delivery_status"),
        late.cast("int").alias("late_delivery_risk"),
        "order_status", "market", "order_region", "order_country", "order_city",
        "days_shipping_real", "days_shipping_scheduled",
        calendar_day("order_date").alias("order_date_day"),
        month_text("order_date").alias("order_month"),
        weekday_name("order_date").alias("order_day_of_week"),
        delta.cast("int").alias("shipment_delay_delta"),
    )


# raw header of the order export (text columns), in file order, and the
# curated column each one carries
RAW_ORDER_HEADER: list[tuple[str, str]] = [
    ("Order Id", "order_id"),
    ("Order Item Id", "order_item_id"),
    ("order date (DateOrders)", "order_date"),
    ("shipping date (DateOrders)", "shipping_date"),
    ("Customer Id", "customer_id"),
    ("Customer Segment", "customer_segment"),
    ("Product Card Id", "product_id"),
    ("Product Name", "product_name"),
    ("Category Id", "category_id"),
    ("Category Name", "category_name"),
    ("Department Id", "department_id"),
    ("Department Name", "department_name"),
    ("Order Item Quantity", "quantity"),
    ("Sales", "sales"),
    ("Order Item Total", "order_item_total"),
    ("Order Profit Per Order", "profit"),
    ("Shipping Mode", "shipping_mode"),
    ("Delivery Status", "delivery_status"),
    ("Late_delivery_risk", "late_delivery_risk"),
    ("Order Status", "order_status"),
    ("Market", "market"),
    ("Order Region", "order_region"),
    ("Order Country", "order_country"),
    ("Order City", "order_city"),
    ("Days for shipping (real)", "days_shipping_real"),
    ("Days for shipment (scheduled)", "days_shipping_scheduled"),
]
RAW_PERSONAL_HEADER: list[str] = [
    "Customer Email", "Customer Fname", "Customer Lname", "Customer Password",
    "Customer Street", "Customer Zipcode", "Latitude", "Longitude",
]
RAW_DATE_FORMAT = "M/d/yyyy H:mm"


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty, all-text form of ``order_lines`` with the raw export header.

    Dates of orders with ``order_id % 97 == 0`` read ``bad``; the segment of
    lines with ``order_item_id % 89 == 0`` is blank; the sales text of lines
    with ``order_item_id % 83 == 0`` is empty. Personal columns hold dummies.
    """
    base = _order_lines(spark, sf_dir, opaque=True)
    bad_date = F.pmod(F.col("order_id"), F.lit(97)) == 0
    cols = []
    for raw, cur in RAW_ORDER_HEADER:
        c = F.col(cur)
        if cur in ("order_date", "shipping_date"):
            c = F.when(bad_date, F.lit("bad")).otherwise(F.date_format(c, RAW_DATE_FORMAT))
        elif cur == "customer_segment":
            c = F.when(F.pmod(F.col("order_item_id"), F.lit(89)) == 0, F.lit("  ")).otherwise(c)
        elif cur == "sales":
            c = F.when(F.pmod(F.col("order_item_id"), F.lit(83)) == 0, F.lit("")).otherwise(c.cast("string"))
        cols.append(c.cast("string").alias(raw))
    personal = [F.concat(F.lit(f"{name.split()[-1].lower()}-"), F.col("order_item_id").cast("string"))
                .alias(name) for name in RAW_PERSONAL_HEADER]
    return base.select(*cols, *personal)


def damaged_export(spark: SparkSession, sf_dir: str, path: str) -> str:
    """``raw_orders`` as a Latin-1 CSV export with damaged lines, written to ``path``.

    Lines with ``order_item_id % 101 = 0`` break off after the fifth field,
    those with ``order_item_id % 101 = 1`` carry two fields too many.
    """
    raw = raw_orders(spark, sf_dir).withColumn("Customer Street", F.concat(F.lit("ru\u00e9-"), F.col("Order Item Id")))
    line, turn = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in raw.columns])), F.pmod(F.col("Order Item Id").cast("bigint"), F.lit(101))
    damaged = F.when(turn == 0, F.substring_index(line, ",", 5)).when(turn == 1, F.concat(line, F.lit(",more,9"))).otherwise(line)
    # one raw column whose name is the header line: the writer must neither quote nor separate
    (raw.select(damaged.alias(",".join(raw.columns))).write.option("header", True).option("encoding", "ISO-8859-1")
     .option("compression", "gzip").option("sep", "\u0001").option("quote", "\u0000").option("escapeQuotes", False).mode("overwrite").csv(path))
    return path


def raw_access_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web access log (text columns) from events, part and pages."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts")
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    # keys cover the whole of both tables (and 0, which no part has)
    ev = ev.withColumn("pk", F.pmod("event_id", part.agg(F.max("p_partkey") + 1).scalar())) \
           .withColumn("pg", F.pmod("event_id", pages.agg(F.max("page_id") + 1).scalar()))
    j = ev.join(part, ev.pk == part.p_partkey, "left").join(pages, ev.pg == pages.page_id, "left")
    return j.select(
        F.col("p_name").alias("Product"),
        F.col("p_type").alias("Category"),
        F.when(F.pmod("event_id", F.lit(61)) == 0, F.lit("n/a"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Date"),
        F.date_format("ts", "MMM").alias("Month"),
        F.when(F.pmod("event_id", F.lit(50)) == 0, F.lit("x"))
        .otherwise(F.hour("ts").cast("string")).alias("Hour"),
        F.col("p_brand").alias("Department"),
        F.concat(F.lit("10.0.0."), F.pmod("event_id", F.lit(250)).cast("string")).alias("ip"),
        F.col("url").alias("url"),
    )


def order_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order key -> the curated order date (same rule as ``order_lines``)."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        add_minutes("o_orderdate", F.pmod(F.col("o_orderkey") * 37, F.lit(1440))).alias("order_date"),
        "o_orderpriority")


def rfid_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed RFID reads derived from the events table."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    starts = order_starts(spark, sf_dir).select("order_id", "order_date")
    stage = None
    for k, v in EVENT_STAGES.items():
        stage = F.when(F.col("event_type") == k, F.lit(v)) if stage is None \
            else stage.when(F.col("event_type") == k, F.lit(v))
    j = ev.join(starts, ev.user_id == starts.order_id, "left")
    return j.select(
        add_minutes("order_date", F.floor(F.col("value") * 10)).alias("timestamp"),
        F.col("user_id").alias("order_id"),
        (F.col("user_id") * LINE_SPAN + 1).alias("order_item_id"),
        stage.alias("event_type"),
        F.concat(F.lit("ANT_0"), (F.lit(1) + F.pmod("event_id", F.lit(4))).cast("string")).alias("antenna_id"),
        (F.lit(-78) + F.pmod("event_id", F.lit(44))).cast("int").alias("rssi"),
        "event_id",
    )


def order_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: priority and late risk (max over its lines; 0 without lines)."""
    starts = order_starts(spark, sf_dir).select("order_id", "o_orderpriority")
    risk = order_lines(spark, sf_dir).groupBy("order_id") \
        .agg(F.max("late_delivery_risk").alias("order_risk"))
    return starts.join(risk, "order_id", "left")


def iot_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings (one per event) with the shipment attributes attached."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value", "props")
    return readings_from_events(ev, order_lookup(spark, sf_dir))


def readings_from_events(ev: DataFrame, lookup: DataFrame) -> DataFrame:
    """Events (batch or stream) -> readings, joined to the per-order lookup."""
    mode, _ = _priority_mode(F.col("o_orderpriority"))
    j = ev.join(lookup, ev.user_id == lookup.order_id, "left").drop("order_id")
    k = F.get_json_object("props", "$.k").cast("double")
    return j.select(
        F.col("ts").alias("timestamp"),
        F.col("user_id").alias("order_id"),
        "event_id",
        F.round(F.lit(10) + F.col("value") / 5, 2).alias("temperature_c"),
        (F.pmod(F.col("event_id") * 7, F.lit(131)) - 10).cast("double").alias("humidity_pct"),
        (k / 125).alias("vibration_g"),
        mode.alias("shipping_mode"),
        F.coalesce(F.col("order_risk"), F.lit(0)).cast("int").alias("late_delivery_risk"),
    )


def stock_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On-hand stock and lead time per product; every 41st product has no stock row."""
    part = read_table(spark, sf_dir, "part", "p_partkey").where(F.pmod("p_partkey", F.lit(41)) != 0)
    return part.select(
        F.col("p_partkey").alias("product_id"),
        (F.pmod(F.col("p_partkey") * 7, F.lit(15))).cast("int").alias("stock_on_hand"),
        (F.lit(3) + F.pmod("p_partkey", F.lit(12))).cast("int").alias("lead_time_days"),
    )


def scored_lines(lines: DataFrame) -> DataFrame:
    """A fixed rule-based score over order lines, for the metric operators."""
    base = F.pmod(F.pmod("order_item_id", F.lit(1000)) * 7919, F.lit(1000)) / F.lit(1000.0)
    bump = F.when(F.col("shipping_mode") != "Standard Class", F.lit(0.3)).otherwise(F.lit(0.0))
    score = F.least(base + bump, F.lit(1.0))
    return lines.select(
        "order_item_id",
        F.col("late_delivery_risk").alias("label"),
        score.alias("score"),
    ).withColumn("prediction", (F.col("score") > 0.5).cast("int"))
