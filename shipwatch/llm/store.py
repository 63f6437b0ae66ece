"""Hand-over tables in the shared folder that the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from shipwatch.session import shared_path


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_path(spark, name)}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a rerun.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
