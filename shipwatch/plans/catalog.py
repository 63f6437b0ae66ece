"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Results are lazy, but for what fits, splits and ranks need first.

The set mirrors the operator inventory: every operator that produces a
table is reachable through at least one named query run over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shipwatch import fixed_values as fv
from shipwatch.functions import parse_number
from shipwatch.operators import (curate, encoding, filters, learn, metrics, model, quality, ranking, sample, sensors,
                                 stock, trace)
from shipwatch.session import shared_path
from shipwatch.sources import fixtures as fx, io
from shipwatch.sources.committed import Store
from shipwatch.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# ---- step 1: curation ---------------------------------------------------------

@query("curated_orders")
def q_curated_orders(spark, sf_dir):
    return curate.curate_orders(fx.raw_orders(spark, sf_dir), on_bad_dates="drop")


@query("export_lines")
def q_export_lines(spark, sf_dir):
    path = fx.damaged_export(spark, sf_dir, f"{shared_path(spark, 'export')}-{uuid.uuid4().hex}")
    good, bad = io.read_raw_csv_checked(spark, path)
    none = F.lit(None).cast("string")
    kept = good.select(F.col("Order Item Id").alias("id"), F.col("Customer Street").alias("street"), F.col("Sales").alias("sales"),
                       F.lit(len(good.columns)).alias("fields"), none.alias("reason"))
    aside = bad.select(F.split("line", ",")[1].alias("id"), none.alias("street"), none.alias("sales"), "fields", "reason")
    return kept.unionByName(aside).select(parse_number("id", "bigint").alias("order_item_id"), "street",
                                          (F.col("sales").isNotNull()).alias("has_sales"), "fields", "reason")


@query("anonymised_customers")
def q_anonymised_customers(spark, sf_dir):
    cur = curate.curate_orders(fx.raw_orders(spark, sf_dir), on_bad_dates="drop")
    return metrics.customer_summary(cur)


@query("rejects_bad_dates")
def q_rejects_bad_dates(spark, sf_dir):
    parsed = curate.parse_order_dates(
        curate.normalize_columns(fx.raw_orders(spark, sf_dir)))
    return curate.bad_date_rows(parsed).select(
        parse_number("order_id", "bigint").alias("order_id"),
        parse_number("order_item_id", "bigint").alias("order_item_id"))


# ---- step 2: filters and order aggregates ---------------------------------------

@query("orders_filtered")
def q_orders_filtered(spark, sf_dir):
    return filters.first_category_orders(fx.order_lines(spark, sf_dir), fx.product_dimension(spark, sf_dir))


@query("orders_filtered_all")
def q_orders_filtered_all(spark, sf_dir):
    return filters.apply_filters(fx.order_lines(spark, sf_dir))


@query("orders_filtered_choice")
def q_orders_filtered_choice(spark, sf_dir):
    return filters.apply_filters(fx.order_lines(spark, sf_dir), markets=["ASIA", "EUROPE"],
                                 shipping_modes=["Same Day", "First Class"])


@query("orders_filtered_empty")
def q_orders_filtered_empty(spark, sf_dir):
    return filters.apply_filters(fx.order_lines(spark, sf_dir), shipping_modes=[])


@query("filter_options")
def q_filter_options(spark, sf_dir):
    return filters.filter_options(fx.order_lines(spark, sf_dir))


@query("orders_daily")
def q_orders_daily(spark, sf_dir):
    return metrics.orders_daily(fx.order_lines(spark, sf_dir))


@query("orders_by_month")
def q_orders_by_month(spark, sf_dir):
    return metrics.orders_by_month(fx.order_lines(spark, sf_dir)).orderBy("order_month")


@query("late_risk_by_mode")
def q_late_risk_by_mode(spark, sf_dir):
    return metrics.late_risk_by_mode(fx.order_lines(spark, sf_dir)) \
        .orderBy(F.desc("late_delivery_rate"), "shipping_mode")


@query("market_region_mode")
def q_market_region_mode(spark, sf_dir):
    return metrics.market_region_mode(fx.order_lines(spark, sf_dir)) \
        .orderBy(F.desc("late_delivery_rate"), "market", "order_region", "shipping_mode")


# ---- shared building blocks -------------------------------------------------------

def lines(spark, sf_dir) -> DataFrame:
    return fx.order_lines(spark, sf_dir)


def classified(spark, sf_dir) -> DataFrame:
    return sensors.classify_readings(sensors.with_shipment_ids(fx.iot_readings(spark, sf_dir)))


def inventory(spark, sf_dir) -> DataFrame:
    daily = metrics.orders_daily(lines(spark, sf_dir))
    return stock.replenishment(stock.product_demand(daily), fx.stock_levels(spark, sf_dir))


def enriched_reads(spark, sf_dir) -> DataFrame:
    return trace.enrich_reads(fx.rfid_reads(spark, sf_dir), lines(spark, sf_dir))


# ---- step 4: samples, distinct, top-k ----------------------------------------------

@query("orders_sample")
def q_orders_sample(spark, sf_dir):
    return sample.sort_orders_sample(sample.orders_sample(lines(spark, sf_dir)))


@query("shipments_distinct")
def q_shipments_distinct(spark, sf_dir):
    return sensors.distinct_shipments(lines(spark, sf_dir))


@query("top_reorder")
def q_top_reorder(spark, sf_dir):
    return stock.top_reorder(inventory(spark, sf_dir), fv.TOP_REORDER_ROWS)


@query("first_alerts")
def q_first_alerts(spark, sf_dir):
    return sensors.alerts(classified(spark, sf_dir)) \
        .orderBy("timestamp", "order_id", "event_id").limit(fv.FIRST_ALERT_ROWS)


# ---- step 5: RFID milestones ---------------------------------------------------------

@query("milestone_plan")
def q_milestone_plan(spark, sf_dir):
    return trace.milestone_plan(lines(spark, sf_dir))


@query("milestone_conformance")
def q_milestone_conformance(spark, sf_dir):
    reads = fx.rfid_reads(spark, sf_dir)
    plan = trace.milestone_plan(trace.with_reads(lines(spark, sf_dir), reads), trace.READS)
    return trace.milestone_conformance(plan, reads, tolerance_minutes=60)


@query("order_trace")
def q_order_trace(spark, sf_dir):
    # the first order that has lines, as the trace view picks it; the predicate
    # reaches the line and order scans through the join on both ids
    first_id = lines(spark, sf_dir).agg(F.min("order_id")).first()[0]
    return filters.order_trace(enriched_reads(spark, sf_dir), first_id)


@query("traces_for_orders")
def q_traces_for_orders(spark, sf_dir):
    orders = filters.apply_filters(lines(spark, sf_dir), markets=["ASIA"])
    return filters.traces_for_orders(enriched_reads(spark, sf_dir), orders)


@query("rfid_coverage")
def q_rfid_coverage(spark, sf_dir):
    return metrics.rfid_coverage(enriched_reads(spark, sf_dir))


# ---- step 6: IoT ------------------------------------------------------------------------

@query("checkpoint_plan")
def q_checkpoint_plan(spark, sf_dir):
    return sensors.checkpoint_plan(lines(spark, sf_dir))


@query("classified_readings")
def q_classified_readings(spark, sf_dir):
    return classified(spark, sf_dir)


@query("iot_status_summary")
def q_iot_status_summary(spark, sf_dir):
    return metrics.status_counts(classified(spark, sf_dir)).orderBy(F.desc("events"), "iot_status")


@query("iot_alerts_for_orders")
def q_iot_alerts_for_orders(spark, sf_dir):
    orders = filters.apply_filters(lines(spark, sf_dir))
    return sensors.alerts(filters.readings_for_orders(classified(spark, sf_dir), orders))


@query("iot_status_for_orders")
def q_iot_status_for_orders(spark, sf_dir):
    orders = filters.apply_filters(lines(spark, sf_dir), shipping_modes=["Standard Class"])
    return metrics.status_counts(filters.readings_for_orders(classified(spark, sf_dir), orders))


@query("first_alerts_for_orders")
def q_first_alerts_for_orders(spark, sf_dir):
    orders = filters.apply_filters(lines(spark, sf_dir), shipping_modes=["Standard Class"])
    found = sensors.alerts(filters.readings_for_orders(classified(spark, sf_dir), orders))
    return found.orderBy("timestamp", "order_id", "event_id").limit(fv.FIRST_ALERT_ROWS)


@query("alert_rate_gap")
def q_alert_rate_gap(spark, sf_dir):
    return sensors.alert_rate_gap(classified(spark, sf_dir)) \
        .orderBy("shipping_mode", "late_delivery_risk")


@query("iot_coverage")
def q_iot_coverage(spark, sf_dir):
    return metrics.iot_coverage(classified(spark, sf_dir))


# ---- step 7: stock ----------------------------------------------------------------------

@query("product_demand")
def q_product_demand(spark, sf_dir):
    return stock.product_demand(metrics.orders_daily(lines(spark, sf_dir)))


@query("replenishment")
def q_replenishment(spark, sf_dir):
    return stock.sort_replenishment(inventory(spark, sf_dir))


@query("stock_by_state")
def q_stock_by_state(spark, sf_dir):
    return filters.stock_status_filter(inventory(spark, sf_dir), ["LOW_STOCK", fv.NO_STOCK_ROW])


@query("stock_summary")
def q_stock_summary(spark, sf_dir):
    return metrics.stock_summary(inventory(spark, sf_dir))


@query("kpis")
def q_kpis(spark, sf_dir):
    return metrics.kpis(filters.apply_filters(lines(spark, sf_dir)),
                        fx.rfid_reads(spark, sf_dir), classified(spark, sf_dir),
                        inventory(spark, sf_dir))


# ---- step 8: model frame, split, profiles, metrics --------------------------------------

def model_source(spark, sf_dir) -> DataFrame:
    """All lines; every 79th quantity is missing, by turns as null and as ``nan``."""
    gap, odd = F.pmod("order_item_id", F.lit(79)) == 0, F.pmod("order_item_id", F.lit(2)) == 1
    text = F.when(~gap, F.col("quantity").cast("string")).when(odd, F.lit("nan"))
    return lines(spark, sf_dir).withColumn("quantity", text)


def frame(spark, sf_dir) -> DataFrame:
    return model.model_frame(model_source(spark, sf_dir), key="order_item_id", check="plan")


def training(spark, sf_dir) -> "learn.TrainingRun":
    """The training over all lines: its split, encoder and model are stored once for the same rows."""
    return learn.TrainingRun(model_source(spark, sf_dir), Store(spark, shared_path(spark, "training")),
                             inputs=fx.line_inputs(spark, sf_dir), rule=f"model source 1, {fx.LINE_RULE}")


@query("model_frame")
def q_model_frame(spark, sf_dir):
    return frame(spark, sf_dir)


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return training(spark, sf_dir).split.select("order_item_id", fv.TARGET_COLUMN, "split")


@query("category_vocabulary")
def q_category_vocabulary(spark, sf_dir):
    return model.category_vocabulary(training(spark, sf_dir).frame)


@query("numeric_profile")
def q_numeric_profile(spark, sf_dir):
    return model.numeric_profile(training(spark, sf_dir).frame)


@query("class_balance")
def q_class_balance(spark, sf_dir):
    return model.class_balance(training(spark, sf_dir).split)


@query("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    return model.classification_metrics(fx.scored_lines(lines(spark, sf_dir)))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return model.confusion_matrix(fx.scored_lines(lines(spark, sf_dir)))


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    return model.roc_auc(fx.scored_lines(lines(spark, sf_dir)))


# ---- step 9: learning -------------------------------------------------------------------------
# What SQL can say exactly has an oracle; the fit itself is checked by its
# gradient in the tests. Its queries read the stored model of the same rows.

@query("encoder_slots")
def q_encoder_slots(spark, sf_dir):
    return training(spark, sf_dir).slots


@query("scaler_constants")
def q_scaler_constants(spark, sf_dir):
    return learn.scaler_constants(training(spark, sf_dir).train).select(
        "feature", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return learn.class_weights(training(spark, sf_dir).train)


@query("run_counts")
def q_run_counts(spark, sf_dir):
    return learn.run_counts(training(spark, sf_dir).split)


@query("filled_scenarios")
def q_filled_scenarios(spark, sf_dir):
    return learn.fill_scenarios(scenarios(spark, sf_dir))


@query("ranked_importance")
def q_ranked_importance(spark, sf_dir):
    return learn.ranked_importance(coefficient_table(spark, sf_dir))


@query("top_features")
def q_top_features(spark, sf_dir):
    return learn.top_features(learn.ranked_importance(coefficient_table(spark, sf_dir)))


@query("feature_schema")
def q_feature_schema(spark, sf_dir):
    return learn.feature_schema(training(spark, sf_dir).frame).select(
        "target_column", F.array_join("categorical_features", ",").alias("categorical_features"),
        F.array_join("numerical_features", ",").alias("numerical_features"),
        F.array_join(F.element_at("categorical_options", F.lit("shipping_mode")), ",").alias("shipping_modes"),
        F.size(F.element_at("categorical_options", F.lit("category_name"))).alias("category_options"),
        F.element_at("categorical_defaults", F.lit("market")).alias("default_market"),
        F.element_at("numerical_defaults", F.lit("quantity")).alias("default_quantity"),
        F.element_at("numerical_min", F.lit("sales")).alias("least_sales"),
        F.element_at("numerical_max", F.lit("sales")).alias("largest_sales"))


def coefficient_table(spark, sf_dir) -> DataFrame:
    """A coefficient per category from the data: its late share against one half."""
    return (lines(spark, sf_dir).groupBy(F.col("category_name").alias("feature"))
            .agg((F.sum("late_delivery_risk") / F.count(F.lit(1)) - F.lit(0.5)).alias("coefficient")))


def scenarios(spark, sf_dir) -> DataFrame:
    """The lanes of the data, some with a field that is missing or no number."""
    lanes = lines(spark, sf_dir).select("shipping_mode", "market", "days_shipping_scheduled", "order_city").distinct()
    days = F.col("days_shipping_scheduled").cast("string")
    return lanes.select(
        F.when(F.col("shipping_mode") != "Same Day", F.col("shipping_mode")).alias("shipping_mode"), "market", "order_city",
        F.when(F.col("market") == "ASIA", F.lit("nan")).when(F.col("market") == "AFRICA", F.lit("soon")).otherwise(days)
        .alias("days_shipping_scheduled"))


@query("late_risk_predictions")
def q_late_risk_predictions(spark, sf_dir):
    return training(spark, sf_dir).predictions()


@query("late_risk_prediction_head")
def q_late_risk_prediction_head(spark, sf_dir):
    return training(spark, sf_dir).prediction_head()


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    return learn.feature_importance(training(spark, sf_dir).terms)


@query("scenario_scores")
def q_scenario_scores(spark, sf_dir):
    return learn.score_scenarios(training(spark, sf_dir).terms, scenarios(spark, sf_dir))


@query("training_run")
def q_training_run(spark, sf_dir):
    return training(spark, sf_dir).record()


@query("encoded_rows")
def q_encoded_rows(spark, sf_dir):
    run = training(spark, sf_dir)
    found = encoding.encoded_rows(run.frame, run.slots, "order_item_id")
    return found.select("order_item_id", F.array_join("slots", ",").alias("slots"))


@query("term_scores")
def q_term_scores(spark, sf_dir):
    run = training(spark, sf_dir)
    scored = learn.score_by_terms(learn.share_terms(run.train, run.slots), run.test)
    return scored.select("order_item_id", F.round("late_delivery_risk_probability", 9).alias("probability"), "late_delivery_risk_pred")


@query("term_scenario_scores")
def q_term_scenario_scores(spark, sf_dir):
    run = training(spark, sf_dir)
    scored = learn.score_scenarios(learn.share_terms(run.train, run.slots), scenarios(spark, sf_dir))
    return scored.withColumn("late_delivery_risk_probability", F.round("late_delivery_risk_probability", 9))


@query("lines_by_profit")
def q_lines_by_profit(spark, sf_dir):
    rows = lines(spark, sf_dir).select("order_item_id", "profit")
    return ranking.global_rank(rows, F.col("profit").desc_nulls_last(), F.col("order_item_id"))


# ---- step 11: streaming (drained with availableNow, read back) -------------------------------

@query("stream_alerts")
def q_stream_alerts(spark, sf_dir):
    return live.run_to_table(live.live_alerts(live.readings_stream(spark, sf_dir)), *live.new_paths(spark, "alerts"))


@query("stream_status_counts")
def q_stream_status_counts(spark, sf_dir):
    return live.run_to_table(live.live_status_counts(live.readings_stream(spark, sf_dir)),
                             *live.new_paths(spark, "status_counts"))


# ---- step 3: web demand, data quality ---------------------------------------------------------

@query("web_demand")
def q_web_demand(spark, sf_dir):
    return curate.sort_web_demand(curate.web_demand(fx.raw_access_logs(spark, sf_dir)))


@query("missing_share")
def q_missing_share(spark, sf_dir):
    return quality.missing_share(fx.raw_orders(spark, sf_dir))


@query("quality_report")
def q_quality_report(spark, sf_dir):
    raw = fx.raw_orders(spark, sf_dir)
    return quality.quality_report(raw, curate.curate_orders(raw, on_bad_dates="drop"))


@query("quality_document")
def q_quality_document(spark, sf_dir):
    raw = fx.raw_orders(spark, sf_dir)
    doc = quality.quality_document(raw, curate.curate_orders(raw, on_bad_dates="drop"))
    return doc.withColumns({
        "top_missing_raw_columns_pct": F.array_join(F.transform(
            F.array_sort(F.map_entries("top_missing_raw_columns_pct")),
            lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 4))), ";"),
        "sensitive_columns_removed": F.array_join("sensitive_columns_removed", ";")})


@query("metrics_table")
def q_metrics_table(spark, sf_dir):
    scored = fx.scored_lines(lines(spark, sf_dir))
    cls = model.classification_metrics(scored)
    auc = model.roc_auc(scored).select("roc_auc")
    return model.metrics_table(metrics.combine_one_row(cls, auc))
