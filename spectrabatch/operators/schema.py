"""Projection, reshaping and schema contracts of wide tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import process_columns, quoted, spectral_columns
from . import rank_index

SHORT_HEAD = 10_000


class SchemaContractError(ValueError):
    """A table lacks columns that a model expects."""


def split_at(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Columns before ``column`` and columns from it on."""
    cut = df.columns.index(column)
    return select_names(df, df.columns[:cut]), select_names(df, df.columns[cut:])


def select_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(n) for n in names])


def swap_columns(df: DataFrame, first: str, second: str) -> DataFrame:
    """Exchange two headers; values and column order stay where they are."""
    exchanged = {first: second, second: first}
    return df.toDF(*[exchanged.get(name, name) for name in df.columns])


def rename_all(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.toDF(*[names.get(name, name) for name in df.columns])


def features_without(df: DataFrame, *excluded: str) -> DataFrame:
    """All columns but the target and, if named, the process block."""
    return select_names(df, [c for c in df.columns if c not in excluded])


def require_columns(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Reorder to the expected columns, or say which ones are missing."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise SchemaContractError(f"missing columns: {', '.join(sorted(missing))}")
    return select_names(df, expected)


def reindex(df: DataFrame, expected: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Expected columns in order; those the table lacks are filled."""
    present = set(df.columns)
    return df.select(*[quoted(c) if c in present else F.lit(fill).alias(c) for c in expected])


def rejoin(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Side-by-side join of two tables by an explicit sample key."""
    return left.join(right, key)


def overview(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: number of rows, columns, spectral and process columns."""
    spectral = spectral_columns(df)
    process = [c for c in process_columns(df) if c != target]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(len(process)).cast("long").alias("n_process"),
        F.lit(len(spectral)).cast("long").alias("n_spectral"),
    )


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """First rows by an explicit key; files have no order in Spark."""
    return row_slice(df, key, 0, n)


def row_slice(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` (0-based, included) to ``stop`` (excluded) in key order.

    A short head is kept in a heap per task. A deep slice would send ``stop``
    rows to one task; there the rank index names the cells that hold the slice,
    and only their rows are numbered. Both need a unique numeric key; any other
    type is refused whatever the range.
    """
    if not isinstance(df.schema[key].dataType, T.NumericType):
        raise TypeError(f"{key} is no numeric key")
    if stop <= SHORT_HEAD:
        return df.orderBy(key).offset(start).limit(stop - start)
    return rank_index.build(df.select(key), key).slice(df, start, stop)
