import datetime as dt

from pyspark.sql import functions as F

from shipwatch.functions import (clean_text, epc, hash_identifier, lot_id, normalize_column_name,
                                 parse_hour, parse_number, parse_timestamp, sensor_id)
from shipwatch.functions.names import normalize_names
from shipwatch.functions.rules import (checkpoint_count, expected_alert_rate, order_quantity,
                                       reorder_point, safety_stock, stock_status, warehouse_for)


def test_normalize_column_name():
    assert normalize_column_name("Order Date (DateOrders)") == "order_date_dateorders"
    assert normalize_column_name("Column A") == "column_a"
    assert normalize_column_name("Column-B") == "column_b"
    assert normalize_column_name("  Days for shipping (real) ") == "days_for_shipping_real"
    assert normalize_column_name("a/b__c$") == "a_b_c"


def test_normalize_names_rejects_collisions():
    import pytest
    with pytest.raises(ValueError):
        normalize_names(["Column A", "column_a"])


def test_hash_identifier(spark):
    df = spark.createDataFrame([(123,), (123,), (None,)], "customer_id long")
    rows = df.select(hash_identifier("customer_id").alias("h")).collect()
    assert rows[0].h == rows[1].h == "cust_a665a45920422f9d"
    assert rows[0].h.startswith("cust_") and len(rows[0].h) == 5 + 16
    import hashlib
    assert rows[2].h == "cust_" + hashlib.sha256(b"nan").hexdigest()[:16]


def test_epc_and_lot(spark):
    df = spark.createDataFrame([(10, 20, 30, "2026-06")],
                               "product_id long, order_id long, order_item_id long, order_month string")
    r = df.select(epc("product_id", "order_id", "order_item_id").alias("e"),
                  lot_id("product_id", "order_month").alias("l"),
                  sensor_id("order_id").alias("s")).first()
    assert r.e == "EPC-10-20-30"
    assert r.l == "LOT-10-202606"
    assert r.s == "SENSOR-0020"


def test_stock_states(spark):
    df = spark.createDataFrame([(5, 10.0), (10, 10.0), (12, 10.0), (125, 100.0), (20, 10.0)],
                               "stock int, reorder_point double")
    got = [r.s for r in df.select(stock_status("stock", "reorder_point").alias("s")).collect()]
    assert got == ["LOW_STOCK", "LOW_STOCK", "WATCH", "WATCH", "NORMAL"]


def test_replenishment_rules(spark):
    df = spark.createDataFrame([(13.7533, 9, 73, 7)],
                               "d double, lead int, stock int, pid long")
    r = df.select(F.bround(safety_stock("d"), 0).cast("int").alias("safety"),
                  F.bround(reorder_point("d", "lead"), 0).cast("int").alias("rop"),
                  order_quantity("d", "lead", "stock").alias("qty"),
                  stock_status("stock", reorder_point("d", "lead")).alias("state"),
                  warehouse_for("pid").alias("wh")).first()
    assert (r.safety, r.rop, r.qty, r.state, r.wh) == (41, 165, 116, "LOW_STOCK", "WH_ECOMMERCE")


def test_alert_rates(spark):
    df = spark.createDataFrame([(0, "First Class"), (1, "Standard Class"), (0, "Same Day"),
                                (1, "Same Day")], "late int, mode string")
    got = [r.r for r in df.select(expected_alert_rate("late", "mode").alias("r")).collect()]
    assert got == [0.04, 0.21, 0.02, 0.14]


def test_checkpoint_count(spark):
    df = spark.createDataFrame([("Same Day",), ("First Class",), ("Standard Class",), ("Drone",)], "m string")
    assert [r.n for r in df.select(checkpoint_count("m").alias("n")).collect()] == [2, 3, 4, 3]


def test_clean_text(spark):
    df = spark.createDataFrame([(" a ",), ("",), (None,), ("nan",), ("\tb\n",)], "t string")
    got = [r.c for r in df.select(clean_text("t").alias("c")).collect()]
    assert got == ["a", "UNKNOWN", "UNKNOWN", "UNKNOWN", "b"]
    got = [r.c for r in df.select(clean_text("t", nan_is_missing=False).alias("c")).collect()]
    assert got[3] == "nan"


def test_parsers(spark):
    df = spark.createDataFrame([("1/5/2020 3:07", "12.5", "7"), ("bad", "x", "x"),
                                ("2020-01-05 03:07:00", "", None)], "d string, n string, h string")
    rows = df.select(parse_timestamp("d").alias("d"), parse_number("n").alias("n"),
                     parse_hour("h").alias("h")).collect()
    assert rows[0].d == dt.datetime(2020, 1, 5, 3, 7) and rows[0].n == 12.5 and rows[0].h == 7
    assert rows[1].d is None and rows[1].n is None and rows[1].h == -1
    assert rows[2].d == dt.datetime(2020, 1, 5, 3, 7) and rows[2].n is None and rows[2].h == -1


def test_integers_are_exact(spark):
    texts = ["9007199254740993", "12.7", "1d", "2f", "12.0", " -7 ", "1.2e1", "+3.", "nan", None, "9223372036854775807", "9223372036854775808"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(parse_number("t", "bigint").alias("n")).collect()]
    assert got == [9007199254740993, None, None, None, 12, -7, None, 3, None, None, 9223372036854775807, None]
    assert [r.n for r in df.select(parse_number("t", "int").alias("n")).collect()][:2] == [None, None]
    got = [r.n for r in df.select(parse_number("t").alias("n")).collect()]
    assert got[1:10] == [12.7, None, None, 12.0, -7.0, 12.0, 3.0, None, None]


def test_every_shape_of_timestamp(spark):
    import datetime as dt
    texts = ["1/5/2020 3:07", "12/31/2020 23:59", "1/5/2020 3:07:09", "2020-01-05 03:07:09", "2020-01-05T03:07:09", "2020-01-05 03:07",
             "2020-01-05", "1/5/2020", "bad", "", None, "13/40/2020 1:00", "2020-01-05 03", " 1/5/2020 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.d for r in df.select(parse_timestamp("t").alias("d")).collect()]
    day = dt.datetime(2020, 1, 5)
    assert got == [day.replace(hour=3, minute=7), dt.datetime(2020, 12, 31, 23, 59), *[day.replace(hour=3, minute=7, second=9)] * 3,
                   day.replace(hour=3, minute=7), day, day, None, None, None, None, None, day]


def test_clean_text_trims_every_ascii_white_sign_and_no_other(spark):
    from shipwatch.functions import clean_text
    values = ["a", " a", "a\t", "\na b\r", "\x0b\x0c", "", " ", "nan", " nan", "\u00a0a\u00a0", "\x01a\x1f", "é", " é", None, "x\x0b"]
    white = " \t\n\x0b\f\r"
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", clean_text("v").alias("a"), clean_text("v", nan_is_missing=False).alias("b")).collect()
    for r in rows:
        t = None if r.v is None else r.v.strip(white)
        assert r.b == (t or "UNKNOWN") and r.a == ("UNKNOWN" if t in (None, "", "nan") else t)
    assert spark.range(3).select(clean_text("id").alias("a")).collect()[2].a == "2"


def test_weekday_names_of_a_week(spark):
    import datetime as dt
    from shipwatch.functions import weekday_name
    days = [dt.datetime(1899, 12, 28, 23, 59) + dt.timedelta(days=k) for k in range(8)] + [None]
    rows = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz").select("d", weekday_name("d").alias("n")).collect()
    assert all(r.n == (r.d and r.d.strftime("%A")) for r in rows)
