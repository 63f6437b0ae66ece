import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shipwatch import fixed_values as fv
from shipwatch.operators import filters, metrics, model, quality, sample, sensors, stock, trace
from shipwatch.operators.curate import curate_orders


def _raw_orders(spark, dates):
    from shipwatch.sources.fixtures import RAW_ORDER_HEADER
    rows = []
    for i, (od, sd) in enumerate(dates):
        vals = {"order_id": str(i), "order_item_id": str(100 + i), "order_date": od,
                "shipping_date": sd, "customer_id": "7", "customer_segment": " Consumer ",
                "product_id": "3", "product_name": "thing", "category_id": "1",
                "category_name": "cat", "department_id": "2", "department_name": "dep",
                "quantity": "2", "sales": "10.5", "order_item_total": "9.5", "profit": "1.0",
                "shipping_mode": "Same Day", "delivery_status": "Late delivery",
                "late_delivery_risk": "1", "order_status": "COMPLETE", "market": "LATAM",
                "order_region": "South", "order_country": "X", "order_city": "Y",
                "days_shipping_real": "2", "days_shipping_scheduled": "0"}
        rows.append(tuple(vals[c] for _, c in RAW_ORDER_HEADER))
    schema = ", ".join(f"`{raw}` string" for raw, _ in RAW_ORDER_HEADER)
    return spark.createDataFrame(rows, schema)


def test_curate_raises_on_bad_dates(spark):
    raw = _raw_orders(spark, [("1/5/2020 3:07", "1/7/2020 3:07"), ("bad", "1/7/2020 3:07")])
    with pytest.raises(ValueError, match="1 rows"):
        curate_orders(raw, on_bad_dates="raise")
    out = curate_orders(raw, on_bad_dates="drop")
    rows = out.collect()
    assert len(rows) == 1
    r = rows[0]
    assert out.columns == fv.OPERATIVE_COLUMNS + fv.DERIVED_ORDER_COLUMNS
    assert r.customer_segment == "Consumer"
    assert r.customer_id_hash == "cust_" + hashlib.sha256(b"7").hexdigest()[:16]
    assert r.order_month == "2020-01" and r.order_day_of_week == "Sunday"
    assert r.shipment_delay_delta == 2 and r.order_date_day == "2020-01-05"


def test_filters_empty_choice(spark):
    df = spark.createDataFrame([("A", "Same Day", "c")], "market string, shipping_mode string, category_name string")
    for kw in ("markets", "shipping_modes", "categories"):
        out = filters.apply_filters(df, **{kw: []})
        assert out.count() == 0 and out.columns == df.columns
    assert filters.apply_filters(df, markets=["A"]).count() == 1
    assert filters.stock_status_filter(
        spark.createDataFrame([("LOW_STOCK",)], "inventory_status string"), []).count() == 0


def test_null_status_is_alert(spark):
    df = spark.createDataFrame([("NORMAL",), (None,), ("TEMP_ALERT",)], "iot_status string")
    assert sensors.alerts(df).count() == 2


def test_classify_readings(spark):
    df = spark.createDataFrame([(22.0, 55.0, 0.25), (40.0, 55.0, 0.2), (22.0, 120.0, 0.2),
                                (22.0, 55.0, 0.9), (0.0, 0.0, 2.0), (None, None, None)],
                               "temperature_c double, humidity_pct double, vibration_g double")
    got = [r.iot_status for r in sensors.classify_readings(df).collect()]
    assert got == ["NORMAL", "TEMP_ALERT", "HUMIDITY_ALERT", "VIBRATION_ALERT", "MULTI_ALERT", "NORMAL"]


def _model_rows():
    return [("Same Day", "LATAM", "R1", "C1", "X", "Consumer", "cat", "dep", "1", "2020-01", "Monday", "0", "2", "10.0", "1"),
            ("First Class", "EU", "R2", "C2", "Y", None, "cat", "dep", "2", "2020-01", "Tuesday", "1", "x", "20.0", "0"),
            ("Second Class", "EU", "R2", "C2", "Y", "  ", "cat", "dep", "3", "2020-02", "Monday", "2", "4", None, "1"),
            ("Standard Class", "US", "R3", "C3", "Z", "Corporate", "cat", "dep", "4", "2020-02", "Friday", "4", "6", "40.0", "0"),
            ("Same Day", "US", "R3", "C3", "Z", "Corporate", "cat", "dep", "5", "2020-03", "Friday", "0", "8", "50.0", "1"),
            ("First Class", "LATAM", "R1", "C1", "X", "Home", "cat", "dep", "6", "2020-03", "Sunday", "1", "10", "60.0", "0")]


MODEL_SCHEMA = ", ".join(f"{c} string" for c in fv.CATEGORICAL_FEATURES + fv.NUMERICAL_FEATURES) + \
    ", late_delivery_risk string"


def test_model_frame(spark):
    df = spark.createDataFrame(_model_rows(), MODEL_SCHEMA)
    mf = model.model_frame(df, key=None)
    assert mf.columns == fv.CATEGORICAL_FEATURES + fv.NUMERICAL_FEATURES + [fv.TARGET_COLUMN]
    types = dict(mf.dtypes)
    assert all(types[c] == "string" for c in fv.CATEGORICAL_FEATURES)
    assert all(types[c] == "double" for c in fv.NUMERICAL_FEATURES)
    rows = mf.collect()
    assert rows[1].customer_segment == "UNKNOWN" and rows[2].customer_segment == "UNKNOWN"
    assert rows[1].quantity == 6.0      # median of 2, 4, 6, 8, 10
    assert rows[2].sales == 40.0        # median of 10, 20, 40, 50, 60
    assert {r.late_delivery_risk for r in rows} == {0, 1}


@pytest.mark.parametrize("bad", ["2", None])
def test_model_frame_bad_target(spark, bad):
    rows = _model_rows()
    rows[0] = rows[0][:-1] + (bad,)
    with pytest.raises(ValueError):
        model.model_frame(spark.createDataFrame(rows, MODEL_SCHEMA), key=None)


def test_leakage_guard(spark):
    frame = model.model_frame(spark.createDataFrame(_model_rows(), MODEL_SCHEMA), key=None)
    x, y = model.features_and_target(frame)
    assert x.columns == fv.CATEGORICAL_FEATURES + fv.NUMERICAL_FEATURES and y.columns == [fv.TARGET_COLUMN]
    for leak in fv.LEAKAGE_COLUMNS:
        with pytest.raises(ValueError, match="leakage"):
            model.features_and_target(frame.withColumn(leak, F.lit(1)))
    with pytest.raises(ValueError, match="missing required"):
        model.features_and_target(frame.drop("sales"))


def test_nan_text_is_a_missing_number(spark):
    rows = _model_rows()
    rows[0] = rows[0][:13] + (" NaN ",) + rows[0][14:]
    mf = model.model_frame(spark.createDataFrame(rows, MODEL_SCHEMA), key=None).collect()
    assert mf[0].sales == mf[2].sales == 45.0        # median of 20, 40, 50, 60
    rows[0] = rows[0][:-1] + ("nan",)
    with pytest.raises(ValueError, match="1 missing"):
        model.model_frame(spark.createDataFrame(rows, MODEL_SCHEMA), key=None)


def test_metrics_from_confusion_counts(spark):
    rows = [(0, 0)] * 4851 + [(0, 1)] * 789 + [(1, 0)] * 3100 + [(1, 1)] * 3760
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = model.classification_metrics(df).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (4851, 789, 3100, 3760)
    assert m.accuracy == pytest.approx(0.68888)
    assert m.precision == 0.8265552868762366
    assert m.recall == 0.5481049562682215
    assert m.f1_score == 0.6591287579980717
    cm = {r.label: (r.pred_0, r.pred_1) for r in model.confusion_matrix(df).collect()}
    assert cm == {0: (4851, 789), 1: (3100, 3760)}
    table = {r.metric: r.value_percent for r in model.metrics_table(model.classification_metrics(df)).collect()}
    assert table["accuracy"] == "68.89%"


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    m = model.classification_metrics(df).first()
    assert (m.precision, m.recall, m.f1_score, m.accuracy) == (0.0, 0.0, 0.0, 1.0)


def _brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_roc_auc_matches_brute_force(spark):
    rnd = random.Random(7)
    pairs = [(round(rnd.random(), 2), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "score double, label int")
    got = model.roc_auc(df).first()
    assert got.roc_auc == pytest.approx(_brute_auc(pairs), abs=1e-12)
    pairs[0] = (1e300, 1)                            # an outlier skews nothing
    got = model.roc_auc(spark.createDataFrame(pairs, "score double, label int")).first()
    assert got.roc_auc == pytest.approx(_brute_auc(pairs), abs=1e-12)


def test_exact_median(spark):
    import statistics
    rnd = random.Random(3)
    for n in (1, 2, 7, 1000):
        vals = [rnd.choice([rnd.random() * 100, float(rnd.randint(0, 5))]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
        assert model.exact_medians(df, ["x"])["x"] == pytest.approx(statistics.median(vals))
    assert model.exact_medians(spark.createDataFrame([(None,)], "x double"), ["x"]) == {"x": None}


def test_exact_sample_matches_hash_order(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    want = sorted(range(5000), key=lambda k: hashlib.md5(f"42-{k}".encode()).hexdigest())[:777]
    got1 = {r.k for r in sample.exact_sample(df.repartition(1), "k", 777).collect()}
    got8 = {r.k for r in sample.exact_sample(df.repartition(8), "k", 777).collect()}
    assert got1 == got8 == set(want)
    assert sample.exact_sample(df, "k", 10_000).count() == 5000


def test_edge_buckets_are_refined(spark, monkeypatch):
    monkeypatch.setattr(sample, "EDGE_ROWS", 3)
    monkeypatch.setattr(sample, "BUCKET_HEX", 1)
    df = spark.range(2000).withColumnRenamed("id", "k")
    want = sorted(range(2000), key=lambda k: hashlib.md5(f"42-{k}".encode()).hexdigest())
    for n in (0, 1, 777, 1999, 2000):
        assert {r.k for r in sample.exact_sample(df, "k", n).collect()} == set(want[:n])


def test_stratified_split_sizes(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(3001)]
    df = spark.createDataFrame(rows, "k long, y int")
    out = sample.stratified_split(df, "k", "y")
    sizes = {(r.y, r.split): r.n for r in out.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    n1 = sum(1 for _, y in rows if y == 1)
    n0 = len(rows) - n1
    # total test size ceil(0.25 * 3001) = 751; 1001 * 751 / 3001 = 250.5..., 2000 * 751 / 3001 = 500.4...
    assert sizes[(1, "test")] + sizes[(0, "test")] == 751
    assert (sizes[(1, "test")], sizes[(0, "test")]) == (251, 500)
    assert sizes[(1, "train")] + sizes[(1, "test")] == n1 and sizes[(0, "train")] + sizes[(0, "test")] == n0
    assert out.count() == len(rows)


def test_split_sizes_of_reference_run(spark):
    # 50,000 rows with a 0.54829 positive rate split 37,500 / 12,500
    df = spark.createDataFrame([(i, 1 if i < 27414 else 0) for i in range(50000)], "k long, y int")
    out = sample.stratified_split(df, "k", "y")
    assert out.filter("split = 'test'").count() == 12500


def test_distinct_shipments_takes_first_line(spark):
    df = spark.createDataFrame([(1, 5, 103, "c"), (1, 5, 101, "a"), (1, 6, 102, "b"), (2, 5, 201, "d")],
                               "order_id long, product_id long, order_item_id long, tag string")
    got = {(r.order_id, r.product_id): r.tag for r in sensors.distinct_shipments(df).collect()}
    assert got == {(1, 5): "a", (1, 6): "b", (2, 5): "d"}


def _lines(spark, mode="Same Day", real=0, od=dt.datetime(2024, 1, 1, 8, 0), ship_days=None):
    sd = od + dt.timedelta(days=real if ship_days is None else ship_days)
    return spark.createDataFrame(
        [(1, 101, od, sd, 7, "p", "2024-01", real, mode, 1, "M", "R")],
        "order_id long, order_item_id long, order_date timestamp_ntz, shipping_date timestamp_ntz, "
        "product_id long, product_name string, order_month string, days_shipping_real int, "
        "shipping_mode string, late_delivery_risk int, market string, order_region string")


def test_checkpoint_plan(spark):
    od = dt.datetime(2024, 1, 1, 8, 0)
    rows = sensors.checkpoint_plan(_lines(spark, "Same Day", 2, od)).orderBy("checkpoint_index").collect()
    assert len(rows) == 2
    assert rows[0].timestamp == od + dt.timedelta(days=2)            # starts at the shipping date
    assert rows[1].timestamp == od + dt.timedelta(days=2, hours=6)   # end not after start -> 6 h
    rows = sensors.checkpoint_plan(_lines(spark, "Drone", 3, od, ship_days=1)).collect()
    assert len(rows) == 3
    ts = sorted(r.timestamp for r in rows)
    assert ts == [od + dt.timedelta(days=1), od + dt.timedelta(days=2), od + dt.timedelta(days=3)]
    assert rows[0].sensor_id == "SENSOR-0001" and rows[0].location == "M | R"


def test_milestone_plan_and_conformance(spark):
    od = dt.datetime(2024, 1, 1, 8, 0)
    plan = trace.milestone_plan(_lines(spark, real=2, od=od))
    rows = {r.event_type: r for r in plan.collect()}
    assert list(rows) == fv.MILESTONE_STAGES
    assert rows["PICKED"].expected_start == od + dt.timedelta(minutes=15)
    assert rows["IN_TRANSIT_SCAN"].expected_end == od + dt.timedelta(days=1, minutes=179)
    assert rows["DELIVERED_OR_CLOSED"].expected_start == od + dt.timedelta(days=2)
    assert rows["RECEIVED"].epc == "EPC-7-1-101" and rows["RECEIVED"].reader_id == "READER_WH_RECEIVING_01"
    reads = spark.createDataFrame([
        (od - dt.timedelta(hours=2), 1, 101, "RECEIVED"),
        (od + dt.timedelta(minutes=100), 1, 101, "PICKED"),
        (od + dt.timedelta(minutes=90), 1, 101, "PICKED"),
        (od + dt.timedelta(hours=20), 1, 101, "PACKED"),
        (od, 9, 901, "SHIPPED")], "timestamp timestamp_ntz, order_id long, order_item_id long, event_type string")
    conf = trace.milestone_conformance(plan, reads, 60)
    got = {(r.order_item_id, r.event_type): (r.conformance, r.read_count) for r in conf.collect()}
    assert got[(101, "RECEIVED")] == ("EARLY", 1)
    assert got[(101, "PICKED")] == ("IN_WINDOW", 2)
    assert got[(101, "PACKED")] == ("LATE", 1)
    assert got[(101, "SHIPPED")] == ("MISSING", 0)
    assert got[(901, "SHIPPED")] == ("UNPLANNED", 1)
    assert conf.count() == 6 + 1


def test_conformance_of_lines_is_that_of_their_plan_and_exchanges_a_line_once(spark):
    od = dt.datetime(2024, 1, 1, 8, 0)
    one = _lines(spark, real=2, od=od)
    other = one.withColumn("order_item_id", F.lit(102).cast("bigint"))
    lines = one.unionByName(one).unionByName(other).unionByName(one.withColumn("order_item_id", F.lit(None).cast("bigint"))) \
        .unionByName(one.withColumns({"order_item_id": F.lit(103).cast("bigint"), "order_date": F.lit(None).cast("timestamp_ntz")}))
    reads = spark.createDataFrame([
        (od - dt.timedelta(hours=2), 1, 101, "RECEIVED"), (od + dt.timedelta(minutes=100), 1, 101, "PICKED"),
        (od + dt.timedelta(minutes=90), 1, 101, "PICKED"), (od, 1, 101, "A STAGE OF NO PLAN"), (od, 1, 101, None), (None, 1, 102, "PACKED"),
        (od, 1, 103, "PICKED"), (od, 9, 901, "SHIPPED"), (od, 9, 901, "PICKED"), (od, 9, None, "SHIPPED"), (od, 9, None, None)],
        "timestamp timestamp_ntz, order_id long, order_item_id long, event_type string")
    want = trace.milestone_conformance(trace.milestone_plan(lines), reads, 60)
    got = trace.milestone_conformance(trace.milestone_plan(trace.with_reads(lines, reads), trace.READS), reads, 60)
    assert got.dtypes == want.dtypes and got.count() == want.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_conformance_query_joins_lines_before_their_stages(spark):
    from shipwatch.plans import catalog
    from tests.conftest import SF_SMALL
    plan = catalog.QUERIES["milestone_conformance"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join FullOuter")


def test_kpis_empty_orders(spark):
    o = spark.createDataFrame([], "order_id long, sales double, late_delivery_risk int")
    r = spark.createDataFrame([(1,), (2,)], "x int")
    i = spark.createDataFrame([("NORMAL",), ("TEMP_ALERT",), (None,)], "iot_status string")
    s = spark.createDataFrame([("LOW_STOCK",), ("WATCH",)], "inventory_status string")
    k = metrics.kpis(o, r, i, s).first()
    assert (k.total_orders, k.total_sales, k.late_rate, k.rfid_events, k.iot_alerts, k.low_stock) == \
        (0, 0.0, 0.0, 2, 2, 1)


def test_product_demand_and_replenishment(spark):
    daily = spark.createDataFrame([
        (dt.date(2024, 1, 1), 1, "a", "c", "d", 4), (dt.date(2024, 1, 2), 1, "a", "c", "d", 6),
        (dt.date(2024, 1, 3), 2, "b", "c", "d", 3), (dt.date(2024, 1, 3), 2, "b", "c", "d", 1)],
        "order_date_day date, product_id long, product_name string, category_name string, "
        "department_name string, quantity int")
    dem = {r.product_id: r for r in stock.product_demand(daily).collect()}
    assert dem[1].total_quantity == 10 and dem[1].active_days == 2 and dem[1].max_daily_demand == 6
    assert dem[1].avg_daily_demand == 10 / 3 and dem[2].avg_active_day_demand == 4.0
    lv = spark.createDataFrame([(1, 0, 3), (2, 100, 3)], "product_id long, stock_on_hand int, lead_time_days int")
    inv = {r.product_id: r for r in stock.replenishment(stock.product_demand(daily), lv).collect()}
    assert inv[1].inventory_status == "LOW_STOCK" and inv[2].inventory_status == "NORMAL"
    assert inv[2].recommended_order_qty == 0
    inv = {r.product_id: r for r in stock.replenishment(stock.product_demand(daily), lv.where("product_id = 1")).collect()}
    assert inv[2].inventory_status == "NO_STOCK_ROW" and inv[2].recommended_order_qty is None


def test_empty_raw_export_is_rejected(spark):
    from shipwatch.sources.fixtures import RAW_ORDER_HEADER
    schema = ", ".join(f"`{raw}` string" for raw, _ in RAW_ORDER_HEADER)
    with pytest.raises(ValueError, match="empty"):
        curate_orders(spark.createDataFrame([], schema))
    assert curate_orders(spark.createDataFrame([], schema), on_bad_dates="drop").count() == 0


def test_top_features(spark):
    from shipwatch.operators.learn import top_features
    df = spark.createDataFrame([(f"f{i}", float(i % 7)) for i in range(30)], "feature string, abs_importance double")
    got = [r.feature for r in top_features(df, 3).collect()]
    assert got == ["f13", "f20", "f27"]


def test_radix_medians_of_any_doubles(spark):
    import statistics
    from shipwatch.operators import medians
    rnd = random.Random(11)
    odd = [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308, -1.7e308]
    for n in (1, 2, 3, 501, 3000):
        some = [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1e-300), rnd.gauss(0, 1e200), float(rnd.randint(-2, 2)), rnd.choice(odd)]) for _ in range(n)]
        near = [1.0 + rnd.randint(0, 40) * 2.0 ** -52 for _ in range(n)]     # equal but for the last bits
        rows = [(a, b, None, "kept") for a, b in zip(some, near)] + [(None, None, None, "x")]
        df = spark.createDataFrame(rows, "x double, y double, none double, feature string").repartition(3)
        got = medians.exact_medians(df, ["x", "y", "none"], ends := {})
        assert got == {"x": statistics.median(some), "y": statistics.median(near), "none": None}
        assert ends["x"] == (min(some), max(some)) and ends["none"] == (None, None)


def test_radix_medians_read_their_input_once_and_run_no_job(spark):
    from shipwatch.operators import medians
    df = spark.range(5000).selectExpr("cast(id % 77 as double) as x", "cast(id as double) as y").repartition(3)
    table = medians.median_table(df, ["x", "y"])
    table.collect()
    final = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Range (") == 1 and "ReusedExchange" in final


def test_target_is_checked_in_the_plan(spark):
    good = spark.createDataFrame(_model_rows(), MODEL_SCHEMA)
    assert model.model_frame(good, key=None, check="plan").collect() == model.model_frame(good, key=None).collect()
    for bad in ("2", None, "late", "nan"):
        rows = _model_rows()
        rows[0] = rows[0][:-1] + (bad,)
        frame = model.model_frame(spark.createDataFrame(rows, MODEL_SCHEMA), key=None, check="plan")    # no job yet
        with pytest.raises(Exception, match="is not 0 or 1"):
            frame.collect()


def test_dates_are_checked_in_the_plan(spark, tmp_path):
    fine = _raw_orders(spark, [("1/5/2020 3:07", "1/7/2020 3:07")])
    assert curate_orders(fine, on_bad_dates="assert").collect() == curate_orders(fine).collect()
    bad = curate_orders(_raw_orders(spark, [("1/5/2020 3:07", "1/7/2020 3:07"), ("1/5/2020 3:07", "soon")]), on_bad_dates="assert")
    with pytest.raises(Exception, match="unparsable order or shipping date"):
        bad.write.parquet(str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists()
    with pytest.raises(Exception, match="unparsable"):
        bad.count() and bad.collect()


def test_global_rank(spark):
    from shipwatch.operators.ranking import global_rank
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, 1.0, 1.0, 1.0, rnd.random()])) for k in range(2000)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(7)
    ranked = global_rank(df, F.col("v").desc_nulls_last(), F.col("k"))
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.k, r.v, r["rank"]) for r in ranked.orderBy("rank").collect()] == [(*r, i + 1) for i, r in enumerate(want)]
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert global_rank(df.limit(0), F.col("k")).count() == 0


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_curation_parses_each_value_once(spark):
    raw = _raw_orders(spark, [("1/31/2018 22:56", "2/1/2018"), ("bad", "2/1/2018")])
    cur = curate_orders(raw, on_bad_dates="drop")
    assert cur.count() == 1
    # two dates, each brought into ISO order by two replacements; a filter that repeats them doubles that
    assert _optimized(cur.select("order_date", "shipping_date")).count("$3-$1-$2") == 2


def test_quality_document_reads_the_raw_rows_once_for_its_figures(spark):
    raw = _raw_orders(spark, [("1/31/2018 22:56", "2/1/2018"), ("bad", "2/1/2018")])
    doc = quality.quality_document(raw, curate_orders(raw, on_bad_dates="drop"))
    assert _optimized(doc).count("LogicalRDD") == 2            # the figures' pass and that of the clean rows
    row = doc.first()
    assert (row["raw_rows"], row["rejected_date_rows"], row["clean_rows"]) == (2, 1, 1)
