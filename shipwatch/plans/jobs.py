"""Batch jobs: operators chained from inputs to written outputs.

Each job runs in one session. Curated orders are written once (Parquet,
partitioned by month so later month filters prune files) and the later
steps scan that table instead of recomputing the curation.

Every table or report is a step: ``step(name, build)`` runs it. By default it
just runs; ``committed_foundation`` hands in the steps of a ``Run``, which skip
what an earlier, broken call has finished.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shipwatch import fixed_values as fv
from shipwatch.operators import curate, curated_schema, learn, metrics, quality, sample, sensors, stock, trace
from shipwatch.session import shared_path
from shipwatch.sources import io
from shipwatch.sources.committed import Run, Store, files_told


def _out(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


Step = Callable[[str, Callable[[], object]], object]


def _plain(name: str, build: Callable[[], object]):
    return build()


def curation_job(spark: SparkSession, raw_orders_path: str, raw_logs_path: str, out_dir: str,
                 on_bad_dates: str = "raise", sample_rows: int = fv.ORDER_SAMPLE_ROWS,
                 seed: int = fv.RANDOM_SEED, step: Step = _plain) -> dict:
    """P1: raw exports -> curated orders, sample, daily, web demand,
    dictionary and quality report."""
    raw = io.read_raw_csv(spark, raw_orders_path)
    step("orders", lambda: io.write_table(
        curate.curate_orders(raw, on_bad_dates=on_bad_dates), _out(out_dir, "orders"),
        partition_by=["order_month"], cluster_by=["order_id", "order_item_id"]))
    orders = spark.read.parquet(_out(out_dir, "orders"))
    # Raw-side figures (row count, missing counts of every column) are one
    # more aggregate pass over the export. Spark's Observation could collect
    # them during the write above, but in Spark 4.1 a session that has used an
    # Observation can no longer serialise pyspark.ml model transforms
    # (NotSerializableException: ObservationManager), so it is not used.
    step("orders_sample", lambda: io.write_table(
        sample.sort_orders_sample(sample.orders_sample(orders, sample_rows, seed)), _out(out_dir, "orders_sample")))
    step("orders_daily", lambda: io.write_table(metrics.orders_daily(orders), _out(out_dir, "orders_daily")))
    step("web_demand", lambda: io.write_table(
        curate.sort_web_demand(curate.web_demand(io.read_raw_csv(spark, raw_logs_path))), _out(out_dir, "web_demand")))
    step("data_dictionary", lambda: io.write_table(curated_schema.data_dictionary(spark), _out(out_dir, "data_dictionary")))
    return step("quality_report", lambda: io.write_json_report(
        quality.quality_document(raw, orders, quality.raw_figures(raw)), _out(out_dir, "quality_report")))


def milestone_job(spark: SparkSession, orders_path: str, out_dir: str,
                  reads: DataFrame | None = None, tolerance_minutes: int = 60,
                  step: Step = _plain) -> dict:
    """P2: milestone plan (and conformance when reads exist), coverage report."""
    orders = io.load_orders(spark, orders_path)
    step("milestone_plan", lambda: io.write_table(trace.milestone_plan(orders), _out(out_dir, "milestone_plan")))
    plan = spark.read.parquet(_out(out_dir, "milestone_plan"))
    if reads is not None:
        step("milestone_conformance", lambda: io.write_table(
            trace.milestone_conformance(plan, reads, tolerance_minutes), _out(out_dir, "milestone_conformance")))
    seen = plan if reads is None else trace.enrich_reads(reads, orders)
    return step("rfid_coverage", lambda: io.write_json_report(metrics.rfid_coverage(seen), _out(out_dir, "rfid_coverage")))


def sensor_job(spark: SparkSession, orders_path: str, out_dir: str,
               readings: DataFrame | None = None, step: Step = _plain) -> dict:
    """P3: checkpoint plan; readings classified when given; coverage report."""
    orders = io.load_orders(spark, orders_path)
    step("checkpoint_plan", lambda: io.write_table(sensors.checkpoint_plan(orders), _out(out_dir, "checkpoint_plan")))
    if readings is None:
        return {}
    step("iot_readings", lambda: io.write_table(
        sensors.classify_readings(sensors.with_shipment_ids(readings)), _out(out_dir, "iot_readings")))
    return step("iot_coverage", lambda: io.write_json_report(
        metrics.iot_coverage(spark.read.parquet(_out(out_dir, "iot_readings"))), _out(out_dir, "iot_coverage")))


def stock_job(spark: SparkSession, daily_path: str, levels: DataFrame, out_dir: str,
              step: Step = _plain) -> dict:
    """P4: demand from the daily table, replenishment against the stock table."""
    daily = io.load_orders_daily(spark, daily_path)
    step("inventory", lambda: io.write_table(
        stock.sort_replenishment(stock.replenishment(stock.product_demand(daily), levels)), _out(out_dir, "inventory")))
    return step("stock_summary", lambda: io.write_json_report(
        metrics.stock_summary(spark.read.parquet(_out(out_dir, "inventory"))), _out(out_dir, "stock_summary")))


def foundation_job(spark: SparkSession, raw_orders_path: str, raw_logs_path: str, out_dir: str,
                   stock_levels: DataFrame, reads: DataFrame | None = None,
                   readings: DataFrame | None = None, on_bad_dates: str = "raise",
                   step: Step = _plain) -> dict:
    """P5: inputs checked first, then P1 to P4 in order."""
    io.check_path(spark, raw_orders_path)
    io.check_path(spark, raw_logs_path)
    out = {"quality": curation_job(spark, raw_orders_path, raw_logs_path, out_dir, on_bad_dates, step=step)}
    out["rfid"] = milestone_job(spark, _out(out_dir, "orders"), out_dir, reads, step=step)
    out["iot"] = sensor_job(spark, _out(out_dir, "orders"), out_dir, readings, step)
    out["stock"] = stock_job(spark, _out(out_dir, "orders_daily"), stock_levels, out_dir, step)
    return out


def committed_foundation(spark: SparkSession, raw_orders_path: str, raw_logs_path: str, out_dir: str, run_id: str,
                         stock_levels: DataFrame, reads: DataFrame | None = None,
                         readings: DataFrame | None = None, on_bad_dates: str = "raise") -> dict:
    """P5 as a run of its own in ``out_dir``; ``committed_run`` names the last one that is whole.

    Called again with the same id after a break, it goes on at the first
    unfinished table. The raw exports must be unchanged since (their files are
    compared); the three tables must be the same as before (that is not checked,
    only which of them are given).
    """
    for path in (raw_orders_path, raw_logs_path):
        io.check_path(spark, path)
    run = Run(spark, out_dir, run_id, {
        "raw": [files_told(spark, p) for p in (raw_orders_path, raw_logs_path)], "on_bad_dates": on_bad_dates,
        "reads": reads is not None, "readings": readings is not None})
    return run.commit(foundation_job(spark, raw_orders_path, raw_logs_path, run.folder, stock_levels, reads, readings,
                                     on_bad_dates, run.step))


def training_job(spark: SparkSession, orders_path: str, out_dir: str) -> dict:
    """J11 with A10: train, evaluate, and save model, metrics, schema,
    importance and predictions."""
    run = learn.TrainingRun(io.load_orders(spark, orders_path), Store(spark, shared_path(spark, "training")))
    root = out_dir.rstrip("/")
    io.save_model(run.model, f"{root}/model")
    record = io.write_json_report(run.record(), f"{root}/metrics")
    io.write_json_report(learn.feature_schema(run.frame.drop("order_item_id")), f"{root}/feature_schema")
    io.export_csv(learn.feature_importance(run.terms), f"{root}/feature_importance")
    io.export_csv(run.predictions(), f"{root}/predictions")
    return record
