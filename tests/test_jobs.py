"""Round trips through the writers/readers and the batch jobs, on sf0.001."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shipwatch.operators import curate, curated_schema, learn, metrics, sensors
from shipwatch.plans import catalog, jobs
from shipwatch.sources import fixtures as fx
from shipwatch.sources import io
from shipwatch.sources.committed import Run, committed_run
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def raw_files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("raw")
    orders = str(d / "orders_csv")
    logs = str(d / "logs_csv")
    io.export_csv(fx.raw_orders(spark, SF_SMALL).coalesce(1), orders)
    io.export_csv(fx.raw_access_logs(spark, SF_SMALL).coalesce(1), logs)
    return orders, logs


def test_raw_csv_round_trip(spark, raw_files):
    raw = io.read_raw_csv(spark, raw_files[0])
    assert "order date (DateOrders)" in raw.columns and len(raw.columns) == 34
    assert dict(raw.dtypes)["Sales"] == "string"
    assert raw.count() == fx.raw_orders(spark, SF_SMALL).count()
    with pytest.raises(FileNotFoundError):
        io.read_raw_csv(spark, raw_files[0] + "_missing")


def test_foundation_job(spark, raw_files, tmp_path):
    out = str(tmp_path / "curated")
    levels = fx.stock_levels(spark, SF_SMALL)
    with pytest.raises(ValueError, match="unparsable"):
        jobs.curation_job(spark, raw_files[0], raw_files[1], out)
    reads = fx.rfid_reads(spark, SF_SMALL)
    readings = fx.iot_readings(spark, SF_SMALL)
    res = jobs.foundation_job(spark, raw_files[0], raw_files[1], out, levels, reads, readings,
                              on_bad_dates="drop")
    q = res["quality"]
    assert q["raw_columns"] == 34 and q["clean_columns"] == 30
    assert q["clean_rows"] < q["raw_rows"]
    assert q["rejected_date_rows"] > 0 and q["rejected_incomplete_rows"] > 0
    assert q["clean_rows"] + q["rejected_date_rows"] + q["rejected_incomplete_rows"] == q["raw_rows"]
    assert q["sensitive_columns_removed"][0] == "customer_email"
    assert set(q["top_missing_raw_columns_pct"]) and q["top_missing_raw_columns_pct"]["Sales"] > 0
    assert res["rfid"]["events"] == reads.count()
    assert res["iot"]["events"] == readings.count()
    assert res["stock"]["products"] > 0
    data = io.register_datasets(spark, out)
    assert {"orders", "orders_sample", "orders_daily", "web_demand", "data_dictionary",
            "milestone_plan", "milestone_conformance", "checkpoint_plan", "iot_readings",
            "inventory", "quality_report"} <= set(data)
    assert spark.sql("SELECT count(*) AS n FROM orders").first().n == q["clean_rows"]
    assert data["data_dictionary"].count() == 30
    # month partitions of the curated table prune on a month filter
    plan = data["orders"].filter(F.col("order_month") == "1995-01")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters" in plan and "order_month" in plan
    with open(next(p for p in (os.path.join(out, "quality_report", f)
                               for f in os.listdir(os.path.join(out, "quality_report")))
                   if p.endswith(".json"))) as fh:
        assert json.loads(fh.readline())["raw_columns"] == 34


def test_a_broken_run_goes_on(spark, raw_files, tmp_path, monkeypatch):
    out = str(tmp_path / "curated")
    given = (spark, raw_files[0], raw_files[1], out, "first", fx.stock_levels(spark, SF_SMALL))

    def fails(*_):
        raise RuntimeError("lost")

    for place, name in ((curate, "web_demand"), (sensors, "checkpoint_plan"), (metrics, "stock_summary")):
        with monkeypatch.context() as m:
            m.setattr(place, name, fails)
            with pytest.raises(RuntimeError, match="lost"):
                jobs.committed_foundation(*given, on_bad_dates="drop")
        with pytest.raises(FileNotFoundError):
            committed_run(spark, out)
    # a table that was half written, without its step's mark, is written anew
    spark.range(3).write.json(f"{out}/run=first/stock_summary", mode="overwrite")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "curated").rglob("*.parquet")}
    assert before
    record = jobs.committed_foundation(*given, on_bad_dates="drop")
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "curated").rglob("*.parquet")}
    assert after == before                              # what was done is not done again
    folder = committed_run(spark, out)
    data = io.register_datasets(spark, folder)
    assert data["orders"].count() == record["quality"]["clean_rows"] > 0
    assert record["stock"]["products"] == data["inventory"].count()
    want = metrics.orders_daily(curate.curate_orders(io.read_raw_csv(spark, raw_files[0]), on_bad_dates="drop"))
    assert data["orders_daily"].count() == want.count() and data["orders_daily"].exceptAll(want).isEmpty()
    assert jobs.committed_foundation(*given, on_bad_dates="drop") == record
    with pytest.raises(ValueError, match="other inputs"):
        jobs.committed_foundation(*given, on_bad_dates="raise")


@pytest.mark.parametrize("broken", range(5))
def test_runs_break_after_any_step(spark, tmp_path, broken):
    root, built = str(tmp_path / "out"), []

    def job(stop):
        run = Run(spark, root, "r", {"a": 1})
        for k in range(4):
            if k == stop:
                raise RuntimeError("lost")
            assert run.step(f"s{k}", lambda k=k: built.append(k) or {"n": k}) == {"n": k}
        if stop == 4:
            raise RuntimeError("lost")
        return run.commit({"steps": 4})

    with pytest.raises(RuntimeError):
        job(broken)
    with pytest.raises(FileNotFoundError):
        committed_run(spark, root)
    assert job(None) == {"steps": 4} and built == [0, 1, 2, 3]
    assert committed_run(spark, root) == f"{root}/run=r"
    Run(spark, root, "a-later-one", {}).commit({})
    assert committed_run(spark, root) == f"{root}/run=a-later-one"


def test_empty_table_is_rejected(spark, tmp_path):
    p = str(tmp_path / "empty")
    io.write_table(spark.createDataFrame([], "order_date_day date, product_id long, product_name string, "
                                             "category_name string, department_name string, quantity int"), p)
    with pytest.raises(ValueError, match="empty"):
        io.load_orders_daily(spark, p)


def test_data_dictionary(spark):
    d = {r.column_name: r for r in curated_schema.data_dictionary(spark).collect()}
    assert len(d) == 30
    assert d["customer_id_hash"].privacy_level == "anonymized"
    assert sum(r.privacy_level == "anonymized" for r in d.values()) == 1
    lines = catalog.lines(spark, SF_SMALL).schema
    assert [(f.name, f.dataType) for f in lines] == [(f.name, f.dataType) for f in curated_schema.CURATED]


def test_training_job_and_model_round_trip(spark, tmp_path):
    orders_path = str(tmp_path / "orders")
    io.write_table(catalog.lines(spark, SF_SMALL), orders_path)
    out = str(tmp_path / "models")
    rec = jobs.training_job(spark, orders_path, out)
    assert rec["train_rows"] + rec["test_rows"] == rec["total_rows"]
    assert 0.0 <= rec["roc_auc"] <= 1.0 and rec["model_name"] == "late_delivery_risk_logistic_regression"
    art = io.load_model_artifacts(spark, out)
    assert set(art) == {"model", "metrics", "feature_schema", "feature_importance", "predictions"}
    assert art["predictions"].count() == rec["test_rows"]
    schema = art["feature_schema"].first()
    assert len(schema["categorical_options"]["shipping_mode"]) == 4
    scen = spark.createDataFrame([("Same Day", None, "x"), (None, "EUROPE", "3")],
                                 "shipping_mode string, market string, quantity string")
    scored = learn.score_scenarios(art["model"], scen).collect()
    assert len(scored) == 2
    assert all(r.late_delivery_risk_class == int(r.late_delivery_risk_probability >= 0.5) for r in scored)
    imp = art["feature_importance"].orderBy("rank").collect()
    assert imp[0]["abs_importance"] >= imp[-1]["abs_importance"]
