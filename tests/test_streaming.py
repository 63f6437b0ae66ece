"""Streams drained with availableNow equal the batch result."""

from pyspark.sql import functions as F

from shipwatch.operators import sensors
from shipwatch.plans import catalog
from shipwatch.streaming import live
from tests.conftest import SF_SMALL


def _sorted(rows):
    return sorted(tuple(r) for r in rows)


def test_stream_alerts_equal_batch(spark):
    streamed = live.run_to_table(live.live_alerts(live.readings_stream(spark, SF_SMALL)), *live.new_paths(spark, "t_alerts"))
    batch = sensors.alerts(catalog.classified(spark, SF_SMALL)).select(*streamed.columns)
    assert _sorted(streamed.collect()) == _sorted(batch.collect())


def test_stream_window_counts_cover_closed_windows(spark):
    streamed = live.run_to_table(live.live_status_counts(live.readings_stream(spark, SF_SMALL)), *live.new_paths(spark, "t_counts"))
    cls = catalog.classified(spark, SF_SMALL)
    max_ts = cls.agg(F.max("timestamp")).first()[0]
    cutoff = spark.createDataFrame([(max_ts,)], "m timestamp_ntz").select(
        F.timestamp_add("MINUTE", F.lit(-10), F.col("m"))).first()[0]
    batch = (cls.withColumn("window_start", F.date_trunc("hour", "timestamp"))
             .withColumn("window_end", F.timestamp_add("HOUR", F.lit(1), F.col("window_start")))
             .filter(F.col("window_end") <= F.lit(cutoff))
             .groupBy("window_start", "window_end", "iot_status").agg(F.count("*").alias("events")))
    assert _sorted(streamed.collect()) == _sorted(batch.select(*streamed.columns).collect())


def test_multi_batch_stream_is_deduplicated(spark):
    # the same file read twice in one stream: duplicates by event id are dropped
    ev = live.readings_stream(spark, SF_SMALL, max_files_per_trigger=1)
    doubled = ev.unionByName(live.readings_stream(spark, SF_SMALL, max_files_per_trigger=1))
    streamed = live.run_to_table(live.live_alerts(doubled), *live.new_paths(spark, "t_dups"))
    assert streamed.count() == streamed.select("event_id").distinct().count()
    assert streamed.count() == sensors.alerts(catalog.classified(spark, SF_SMALL)).count()


def test_a_restarted_stream_goes_on_where_it_ended(spark, tmp_path):
    """Two files, a stop between them, duplicates and late events in the second."""
    import datetime as dt
    start = dt.datetime(2024, 1, 1)
    schema = ("timestamp timestamp_ntz, order_id long, event_id long, temperature_c double, humidity_pct double, "
              "vibration_g double, shipping_mode string, late_delivery_risk int")

    def events(ids):
        return [(start + dt.timedelta(minutes=m), 1, i, t, 50.0, 0.2, "Same Day", 0) for i, m, t in ids]

    def stream():
        return live.live_alerts(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(source))

    source, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    spark.createDataFrame(events([(1, 0, 40.0), (2, 60, 40.0), (3, 61, 20.0)]), schema).coalesce(1).write.parquet(source)
    first = live.run_to_table(stream(), output, checkpoint)
    assert sorted(r.event_id for r in first.collect()) == [1, 2]
    again = live.run_to_table(stream(), output, checkpoint)                 # nothing new: nothing is written twice
    assert sorted(r.event_id for r in again.collect()) == [1, 2]
    spark.createDataFrame(events([(2, 60, 40.0), (4, 62, 40.0), (5, 5, 40.0)]), schema).coalesce(1).write.mode("append").parquet(source)
    more = live.run_to_table(stream(), output, checkpoint)
    # the duplicate goes by the state of the first run; the late event is behind the watermark
    assert sorted(r.event_id for r in more.collect()) == [1, 2, 4]


def test_no_scratch_folder_off_local_masters():
    import pytest
    from shipwatch import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.ensure_checkpoint_dir(Session())
