"""Schema operators: header normalisation, renames, column checks, projections."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from shipwatch.functions.names import normalize_names


def normalize_columns(df: DataFrame, reject_empty: bool = False) -> DataFrame:
    """Snake-case every column name.

    With ``reject_empty`` an input without rows is an error. That check runs
    the input's own plan until a row comes: cheap on a file, but on a computed
    table with shuffles it costs most of a pass, so callers that count rows
    anyway leave it off.
    """
    if reject_empty and df.isEmpty():
        raise ValueError("the table is empty; there are no columns to normalise")
    return df.toDF(*normalize_names(df.columns))


def rename_present(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by map; names not present are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    """Raise ValueError listing the required columns that are missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(sorted(missing))}")
    return df


def drop_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist (deny-list projection)."""
    return df.drop(*[c for c in columns if c in df.columns])


def project(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """Allow-list projection, checked first."""
    require_columns(df, columns, what)
    return df.select(*columns)


def unpivoted(df: DataFrame, columns: list[str], kind: str, value: str, keep: list[str] | None = None) -> DataFrame:
    """(*keep, feature, ``value``): a row for each of ``columns``, whose values are cast to ``kind``."""
    keep = keep or []
    cast = df.select(*keep, *[F.col(f"`{c}`").cast(kind).alias(c) for c in columns])
    return cast.unpivot(keep, [f"`{c}`" for c in columns], "feature", value)


def computed_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows, whose ``columns`` (computed below) are computed once a row.

    A filter on a computed column is pushed below the column, which repeats its
    expression in the filter, and so do later columns that use it. Here they
    pass through a generator of one row, which no expression is moved through.
    """
    packed = df.withColumn("_once", F.struct(*[F.col(c) for c in columns]))
    return packed.select(*[c for c in df.columns if c not in columns], F.inline(F.array("_once")))
