"""Live sensor alerts and windowed status counts with Structured Streaming.

The transforms are the batch ones (``classify_readings``) applied to a
streaming DataFrame; event time is the reading timestamp, with a watermark so
state stays bounded. Zone-less timestamps are cast to session-zone
timestamps for the watermark (``withWatermark`` needs TIMESTAMP) and back to
zone-less on output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from shipwatch.operators.sensors import classify_readings, with_shipment_ids
from shipwatch.session import shared_path
from shipwatch.sources import fixtures as fx
from shipwatch.sources.tables import read_table, table_path, table_schema

EVENT_TIME = "event_time"


def readings_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Sensor readings as a stream over the events files.

    Shipment attributes come from a stream-static left join on the order id;
    the static side is the small per-order table, the stream is never shuffled
    against the whole order-line table.
    """
    schema = table_schema("events") or read_table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # the file source watches a directory; pick the events file(s) by name
    path = table_path(sf_dir, "events")
    folder, name = path.rsplit("/", 1)
    ev = reader.option("pathGlobFilter", name).parquet(folder)
    # the per-order lookup is written once to the shared checkpoint folder, so
    # micro-batches scan a table instead of re-running the line aggregate
    lookup = fx.order_lookup(spark, sf_dir).checkpoint(eager=True)
    return fx.readings_from_events(ev, lookup)


def live_alerts(readings: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """De-duplicated (by event id, within the watermark), classified, alerts only."""
    timed = readings.withColumn(EVENT_TIME, F.col("timestamp").cast("timestamp"))
    deduped = timed.withWatermark(EVENT_TIME, delay).dropDuplicatesWithinWatermark(["event_id"])
    classified = classify_readings(with_shipment_ids(deduped))
    return classified.filter(~F.col("iot_status").eqNullSafe("NORMAL")).drop(EVENT_TIME)


def live_status_counts(readings: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Readings per status and tumbling event-time window (append mode)."""
    timed = readings.withColumn(EVENT_TIME, F.col("timestamp").cast("timestamp"))
    classified = classify_readings(timed.withWatermark(EVENT_TIME, delay))
    counts = classified.groupBy(F.window(EVENT_TIME, window).alias("w"), "iot_status") \
        .agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                         F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                         "iot_status", "events")


def new_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """Fresh output and checkpoint paths in the shared folder, for a run of its own."""
    base = shared_path(spark, f"shipwatch-stream/{name}-{uuid.uuid4().hex}")
    return f"{base}/data", f"{base}/checkpoint"


def run_to_table(stream: DataFrame, output: str, checkpoint: str, output_mode: str = "append") -> DataFrame:
    """Drain the stream's available input into Parquet at ``output``, then read
    all that the stream has written there as a batch DataFrame.

    ``availableNow`` processes what is there and stops. A later call with the
    same two paths goes on where the ``checkpoint`` ended, after a normal end
    as after a loss of the driver: input that is committed is not read again.
    """
    spark = stream.sparkSession
    q = (stream.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", checkpoint).option("path", output)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(output)
