"""RFID milestones: expected plan per order line and conformance of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shipwatch import fixed_values as fv
from shipwatch.functions import epc, lot_id
from shipwatch.functions.rules import add_minutes, closing_time, transit_midpoint
from shipwatch.operators.schema_ops import require_columns

PLAN_INPUT = ["order_id", "order_item_id", "order_date", "shipping_date", "product_id",
              "product_name", "order_month", "days_shipping_real"]
READS = ("is_line", "read_item_id", "seen")
CONFORMANCE_STATES = ["EARLY", "IN_WINDOW", "LATE", "MISSING", "UNPLANNED"]


def _stage_map(values: dict[str, str]):
    pairs = []
    for k in fv.MILESTONE_STAGES:
        pairs += [F.lit(k), F.lit(values[k])]
    return F.create_map(*pairs)


def reader_for(stage) -> F.Column:
    return F.element_at(_stage_map(fv.MILESTONE_READERS), stage)


def location_for(stage) -> F.Column:
    return F.element_at(_stage_map(fv.MILESTONE_LOCATIONS), stage)


def milestone_plan(orders: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Each order line -> one row per milestone stage with its expected window.

    A narrow ``explode`` of a 6-element array: no shuffle, output = 6 x input.
    The columns ``also`` of the lines come last.
    """
    require_columns(orders, PLAN_INPUT, "orders for milestone plan")
    od, sd, real = F.col("order_date"), F.col("shipping_date"), F.col("days_shipping_real")
    mid = transit_midpoint(od, real)
    close = closing_time(od, sd, real)
    windows = {
        "RECEIVED": (od, od),
        "PICKED": (add_minutes(od, F.lit(fv.PICKED_MINUTES[0])), add_minutes(od, F.lit(fv.PICKED_MINUTES[1]))),
        "PACKED": (add_minutes(od, F.lit(fv.PACKED_MINUTES[0])), add_minutes(od, F.lit(fv.PACKED_MINUTES[1]))),
        "SHIPPED": (sd, sd),
        "IN_TRANSIT_SCAN": (add_minutes(mid, F.lit(fv.IN_TRANSIT_MINUTES[0])),
                            add_minutes(mid, F.lit(fv.IN_TRANSIT_MINUTES[1]))),
        "DELIVERED_OR_CLOSED": (close, close),
    }
    stages = F.array(*[
        F.struct(F.lit(i + 1).alias("stage_seq"), F.lit(s).alias("event_type"),
                 lo.alias("expected_start"), hi.alias("expected_end"))
        for i, (s, (lo, hi)) in enumerate((s, windows[s]) for s in fv.MILESTONE_STAGES)])
    exploded = orders.select(
        "order_id", "order_item_id", "product_id", "product_name",
        epc("product_id", "order_id", "order_item_id").alias("epc"),
        lot_id("product_id", "order_month").alias("lot_id"),
        *also, F.explode(stages).alias("m"))
    return exploded.select(
        "order_id", "order_item_id", "product_id", "product_name", "epc", "lot_id",
        "m.stage_seq", "m.event_type",
        reader_for(F.col("m.event_type")).alias("reader_id"),
        location_for(F.col("m.event_type")).alias("location"),
        "m.expected_start", "m.expected_end", *also)


def first_reads(reads: DataFrame) -> DataFrame:
    """Earliest read and read count per (order line, stage).

    A partial (map-side) aggregate, so a line read thousands of times
    collapses before the shuffle.
    """
    return (reads.groupBy("order_item_id", "event_type")
            .agg(F.min("timestamp").alias("first_read"),
                 F.count(F.lit(1)).alias("read_count"),
                 F.min("order_id").alias("read_order_id")))


def of_a_stage() -> F.Column:
    return F.coalesce(F.col("event_type").isin(*fv.MILESTONE_STAGES), F.lit(False))


def with_reads(orders: DataFrame, reads: DataFrame) -> DataFrame:
    """Order lines with their first reads as a map by stage (``READS``), and a row for the reads of no line.

    ``milestone_plan(.., READS)`` carries them to the plan rows. So a line is
    exchanged once, with its dates, instead of six times with a stage and its
    window.
    """
    by_line = first_reads(reads).where(of_a_stage()).groupBy(F.col("order_item_id").alias("read_item_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", F.struct("first_read", "read_count", "read_order_id")))).alias("seen"))
    lines = orders.select(*PLAN_INPUT, F.lit(True).alias("is_line"))
    return lines.join(by_line, F.col("order_item_id") == F.col("read_item_id"), "full_outer")


def milestone_conformance(plan: DataFrame, reads: DataFrame, tolerance_minutes: int = 60) -> DataFrame:
    """Plan rows vs. observed reads, classed EARLY/IN_WINDOW/LATE/MISSING/UNPLANNED.

    Reads reduce to one row per (line, stage) first, so the full outer join is
    1:1 on its key and cannot blow up on a hot line. A plan of lines that have
    their reads (``with_reads``) is not joined again.
    """
    seen = first_reads(reads)
    if set(READS) <= set(plan.columns):
        # the reads of no line have six rows as well: those of their stages stay; reads of no stage can meet no plan row
        met = plan.withColumn("read", F.try_element_at("seen", F.col("event_type"))) \
            .where(F.col("is_line").isNotNull() | F.col("read").isNotNull())
        rows = met.select("order_id", F.coalesce("order_item_id", "read_item_id").alias("order_item_id"),
                          "event_type", "expected_start", "expected_end", "read.*")
        j = rows.unionByName(seen.where(~of_a_stage()), allowMissingColumns=True)
    else:
        j = plan.join(seen, ["order_item_id", "event_type"], "full_outer")
    tol = F.lit(tolerance_minutes)
    lo = add_minutes(F.col("expected_start"), -tol)
    hi = add_minutes(F.col("expected_end"), tol)
    status = (F.when(F.col("expected_start").isNull(), F.lit("UNPLANNED"))
              .when(F.col("first_read").isNull(), F.lit("MISSING"))
              .when(F.col("first_read") < lo, F.lit("EARLY"))
              .when(F.col("first_read") > hi, F.lit("LATE"))
              .otherwise(F.lit("IN_WINDOW")))
    return j.select(
        F.coalesce("order_id", "read_order_id").alias("order_id"),
        "order_item_id", "event_type", "expected_start", "expected_end", "first_read",
        F.coalesce("read_count", F.lit(0)).cast("bigint").alias("read_count"),
        status.alias("conformance"))


def conformance_counts(conformance: DataFrame) -> DataFrame:
    return conformance.groupBy("conformance").agg(F.count(F.lit(1)).alias("rows"))


def enrich_reads(reads: DataFrame, orders: DataFrame) -> DataFrame:
    """Attach EPC, lot, reader and location to observed reads.

    The line attributes come from a join on the order and line ids (so a
    predicate on the order prunes the lines too); reads of unknown lines keep
    null EPC and lot.
    """
    lines = orders.select("order_id", "order_item_id", "product_id", "product_name", "order_month")
    j = reads.join(lines, ["order_id", "order_item_id"], "left")
    return j.select(
        "timestamp",
        F.when(F.col("product_id").isNotNull(),
               epc("product_id", "order_id", "order_item_id")).alias("epc"),
        "order_id", "order_item_id", "product_id", "product_name",
        F.when(F.col("product_id").isNotNull(), lot_id("product_id", "order_month")).alias("lot_id"),
        reader_for(F.col("event_type")).alias("reader_id"),
        "antenna_id", "event_type",
        location_for(F.col("event_type")).alias("location"),
        "rssi")
