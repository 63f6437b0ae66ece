"""Session construction and the few session-level settings we rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every shipwatch job wants. Callers on a cluster normally pass their
# own session; these are applied only by ``get_session`` (tests, bench, CLI).
DEFAULT_CONF: dict[str, str] = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}

# The JVM compiles no method of more bytecode than this: generated code beyond it
# would be interpreted for the whole run, so Spark is told to run such a stage
# operator by operator, in methods that are compiled.
COMPILED_METHOD_BYTES = 8000

# What a task reads of a shuffle, and the input that counts as one shuffle partition
# (order lines take some two and a half times their Parquet size in a shuffle):
# with both, the memory of a task stays the same however large the input is.
TASK_SHUFFLE_BYTES = 16 << 20
PARTITION_INPUT_BYTES = 4 << 20

# A table is broadcast without a hint up to this size of its Parquet file's share,
# or of its rows once they are shuffled. Parquet packs keys and repeated text many
# times over, so Spark's 10 MB of a file may be a gigabyte in every task.
BROADCAST_FILE_BYTES = 1 << 20
BROADCAST_ROW_BYTES = 10 << 20


def get_session(master: str | None = None, app_name: str = "shipwatch",
                shuffle_partitions: int | None = None,
                extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with shipwatch defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_compiled_code(spark)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Pin the session zone to UTC.

    The curated tables carry zone-less (NTZ) timestamps; formatting and the
    LTZ casts needed by streaming watermarks are only wall-clock exact in UTC.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_compiled_code(spark: SparkSession) -> None:
    """Keep Spark from one generated method a stage where the JVM would not compile it."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) > COMPILED_METHOD_BYTES:
        spark.conf.set(key, str(COMPILED_METHOD_BYTES))


def ensure_task_sizes(spark: SparkSession, sf_dir: str) -> None:
    """Shuffle partitions by the size of the input (adaptive execution joins the small ones), and what may be broadcast."""
    advisory, initial = (f"spark.sql.adaptive.{k}" for k in ("advisoryPartitionSizeInBytes", "coalescePartitions.initialPartitionNum"))
    if spark.conf.get(advisory) == f"{64 << 20}b":                  # Spark's default: nobody has set it
        spark.conf.set(advisory, f"{TASK_SHUFFLE_BYTES}b")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    length = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    static = "spark.sql.autoBroadcastJoinThreshold"
    if spark.conf.get(static) == f"{10 << 20}b":                    # Spark's default as well
        spark.conf.set(static, f"{BROADCAST_FILE_BYTES}b")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", f"{BROADCAST_ROW_BYTES}b")
    spark.conf.set(initial, str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-length // PARTITION_INPUT_BYTES))))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint directory, setting one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant
    folder and is left alone. Only a local session without one gets a scratch
    folder; on a cluster that would be a folder that no other machine sees, so
    a missing setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        configured = tempfile.mkdtemp(prefix="shipwatch-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the session's checkpoint folder for hand-over tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
