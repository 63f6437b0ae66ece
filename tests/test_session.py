from __spark_entry__ import queries
from shipwatch import session
from shipwatch.sources import fixtures as fx
from tests.conftest import SF_SMALL


def test_generated_methods_stay_small_enough_to_be_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    try:
        queries()["rejects_bad_dates"](spark, SF_SMALL)
        assert int(spark.conf.get(key)) == session.COMPILED_METHOD_BYTES
    finally:
        session.ensure_compiled_code(spark)


def test_shuffle_partitions_follow_the_input(spark, monkeypatch):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        session.ensure_task_sizes(spark, SF_SMALL)
        assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == f"{session.TASK_SHUFFLE_BYTES}b"
        monkeypatch.setattr(session, "PARTITION_INPUT_BYTES", 1000)
        session.ensure_task_sizes(spark, SF_SMALL)
        assert int(spark.conf.get(key)) > 100
    finally:
        spark.conf.unset(key)


def test_damaged_export_is_written_compressed(spark, tmp_path):
    path = fx.damaged_export(spark, SF_SMALL, str(tmp_path / "export"))
    parts = [p.name for p in (tmp_path / "export").glob("part-*")]
    assert parts and all(p.endswith(".csv.gz") for p in parts) and path == str(tmp_path / "export")


def test_a_tables_file_size_does_not_make_it_a_broadcast(spark):
    static, running = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.unset(static)
    try:
        session.ensure_task_sizes(spark, SF_SMALL)
        assert spark.conf.get(static) == f"{1 << 20}b" and spark.conf.get(running) == f"{10 << 20}b"
        spark.conf.set(static, "-1")                      # what a user has set stays
        session.ensure_task_sizes(spark, SF_SMALL)
        assert spark.conf.get(static) == "-1"
    finally:
        spark.conf.unset(static)
        spark.conf.unset(running)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
