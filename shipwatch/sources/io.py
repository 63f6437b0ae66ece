"""Readers and writers: raw CSV exports, curated tables, JSON reports, models.

Curated tables are written as Parquet by default (columnar, predicate and
partition pruning); CSV with a header is available for exports.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shipwatch import fixed_values as fv
from shipwatch.operators.learn import LateRiskModel
from shipwatch.operators.schema_ops import require_columns

RAW_ENCODING = "ISO-8859-1"
# fixed values: texts that the usual CSV readers take as a missing field
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                  "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

ORDERS_REQUIRED = ["order_id", "order_item_id", "order_date", "shipping_date", "product_id",
                   "product_name", "order_month", "days_shipping_real", "delivery_status",
                   "shipping_mode", "late_delivery_risk", "market", "order_region"]
DAILY_REQUIRED = ["order_date_day", "product_id", "product_name", "category_name",
                  "department_name", "quantity"]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def check_path(spark: SparkSession, path: str) -> str:
    if not _exists(spark, path):
        raise FileNotFoundError(f"no such input: {path}")
    return path


def read_raw_csv(spark: SparkSession, path: str, encoding: str = RAW_ENCODING) -> DataFrame:
    """Raw export: header row, Latin-1, every column read as text (no inference pass)."""
    check_path(spark, path)
    df = (spark.read.option("header", True).option("encoding", encoding)
          .option("inferSchema", False).option("mode", "FAILFAST").csv(path))
    if not df.columns:
        raise ValueError(f"no header in {path}")
    return df.select([F.when(~F.col(f"`{c}`").isin(MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])


CORRUPT = "_line"


def read_raw_csv_checked(spark: SparkSession, path: str, encoding: str = RAW_ENCODING) -> tuple[DataFrame, DataFrame]:
    """The raw export without its damaged lines, and these lines with the reason.

    A line is damaged if it has not as many fields as the header. The first
    table is as ``read_raw_csv`` gives it; the second has ``line``, ``fields``
    (as many as the line has), ``expected`` and ``reason``. Both are lazy: one
    bad line sets itself aside and does not fail the job.
    """
    check_path(spark, path)
    options = {"header": True, "encoding": encoding}
    names = spark.read.options(**options).option("inferSchema", False).csv(path).columns
    if not names:
        raise ValueError(f"no header in {path}")
    schema = StructType([StructField(c, StringType()) for c in [*names, CORRUPT]])
    # all fields are read, whatever is selected: only so every line is looked at as a whole
    rows = spark.read.schema(schema).options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False).csv(path)
    # Spark refuses to look at the damaged line alone, without a field beside it
    beside = F.length(F.concat_ws("", F.col(f"`{names[0]}`"))) >= 0
    good = rows.where(F.col(CORRUPT).isNull() & beside).select(
        [F.when(~F.col(f"`{c}`").isin(MISSING_TOKENS), F.col(f"`{c}`")).alias(c) for c in names])
    # quoted parts count as one letter each, so that their commas separate nothing
    fields = F.size(F.split(F.regexp_replace(F.col(CORRUPT), r'"(?:[^"\\]|\\.)*"', "q"), ","))
    bad = rows.where(F.col(CORRUPT).isNotNull() & beside).select(
        F.col(CORRUPT).alias("line"), fields.alias("fields"), F.lit(len(names)).alias("expected"))
    return good, bad.withColumn("reason", F.when(F.col("fields") < F.col("expected"), "too few fields")
                                .when(F.col("fields") > F.col("expected"), "too many fields").otherwise("unreadable"))


def read_curated(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None,
                 required: Iterable[str] = (), what: str = "table") -> DataFrame:
    """Curated table; fails when the path is missing, a column is missing, or it is empty."""
    check_path(spark, path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).csv(path)
    else:
        df = reader.format(fmt).load(path)
    require_columns(df, list(required), what)
    if df.isEmpty():
        raise ValueError(f"{what} at {path} is empty")
    return df


def load_orders(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_curated(spark, path, fmt, required=ORDERS_REQUIRED, what="curated orders")


def load_orders_daily(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_curated(spark, path, fmt, required=DAILY_REQUIRED, what="daily aggregate")


def read_json_report(spark: SparkSession, path: str) -> DataFrame:
    check_path(spark, path)
    return spark.read.option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None, cluster_by: list[str] | None = None) -> str:
    """Overwrite ``path`` with ``df``; CSV gets a header row.

    With ``partition_by`` the rows are first range-partitioned on the
    partition columns plus ``cluster_by`` and sorted within each task: every
    task then writes files for a few adjacent partition values only (no
    tasks x partitions small-file explosion), a hot partition value is split
    across several tasks by the ``cluster_by`` columns, and the files carry
    tight min/max statistics on those columns for row-group skipping.
    """
    if partition_by:
        keys = [*partition_by, *(cluster_by or [])]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_json_report(report: DataFrame, path: str) -> dict:
    """A one-row report as JSON (UTF-8, non-ASCII kept as is); returns its values.

    The report is computed once: its one row is read, and that row is written.
    """
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a JSON report must have exactly one row")
    report.sparkSession.createDataFrame(rows, report.schema).coalesce(1).write.mode("overwrite").json(path)
    return json.loads(json.dumps(rows[0].asDict(recursive=True), default=str))


def export_csv(df: DataFrame, path: str) -> str:
    return write_table(df, path, "csv")


def save_model(model: LateRiskModel, path: str) -> str:
    return model.save(path)


def load_model(path: str) -> LateRiskModel:
    return LateRiskModel.load(path)


# dataset name -> (relative path, format, required columns) of the curated layer
DATASETS: dict[str, tuple[str, str, list[str]]] = {
    "orders": ("orders", "parquet", ORDERS_REQUIRED),
    "orders_sample": ("orders_sample", "parquet", ORDERS_REQUIRED),
    "orders_daily": ("orders_daily", "parquet", DAILY_REQUIRED),
    "web_demand": ("web_demand", "parquet", []),
    "data_dictionary": ("data_dictionary", "parquet", []),
    "milestone_plan": ("milestone_plan", "parquet", []),
    "milestone_conformance": ("milestone_conformance", "parquet", []),
    "checkpoint_plan": ("checkpoint_plan", "parquet", []),
    "iot_readings": ("iot_readings", "parquet", []),
    "inventory": ("inventory", "parquet", []),
}
REPORTS = ["quality_report", "rfid_coverage", "iot_coverage", "stock_summary"]
MODEL_ARTEFACTS = ["model", "metrics", "feature_schema", "feature_importance", "predictions"]


# the tables beside a saved model: declared, never inferred
MODEL_TABLES: dict[str, str] = {
    "feature_importance": "rank int, feature string, coefficient double, abs_importance double",
    "predictions": (
        "order_item_id bigint, " + ", ".join(f"{c} string" for c in fv.CATEGORICAL_FEATURES) + ", "
        + ", ".join(f"{c} double" for c in fv.NUMERICAL_FEATURES)
        + ", late_delivery_risk_real int, late_delivery_risk_pred int, late_delivery_risk_probability double"),
}


def register_datasets(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Load every dataset present under ``base`` and expose it as a temp view."""
    out = {}
    for name, (rel, fmt, req) in DATASETS.items():
        path = f"{base.rstrip('/')}/{rel}"
        if _exists(spark, path):
            df = read_curated(spark, path, fmt, required=req, what=name)
            df.createOrReplaceTempView(name)
            out[name] = df
    for name in REPORTS:
        path = f"{base.rstrip('/')}/{name}"
        if _exists(spark, path):
            out[name] = read_json_report(spark, path)
    return out


def load_model_artifacts(spark: SparkSession, base: str) -> dict[str, object]:
    """The saved model and its tables/reports, whichever exist."""
    root = base.rstrip("/")
    out: dict[str, object] = {}
    if _exists(spark, f"{root}/model"):
        out["model"] = load_model(f"{root}/model")
    for name in ("metrics", "feature_schema"):
        if _exists(spark, f"{root}/{name}"):
            out[name] = read_json_report(spark, f"{root}/{name}")
    for name in ("feature_importance", "predictions"):
        if _exists(spark, f"{root}/{name}"):
            out[name] = read_curated(spark, f"{root}/{name}", "csv", MODEL_TABLES[name], what=name)
    return out

