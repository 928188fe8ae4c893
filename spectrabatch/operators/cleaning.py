"""Missing, malformed and non-finite values; length validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, numeric
from ..functions.names import process_columns, quoted


def _rewrite(df: DataFrame, chosen: Sequence[str], function) -> DataFrame:
    wanted = set(chosen)
    return df.select(*[function(quoted(c)).alias(c) if c in wanted else quoted(c) for c in df.columns])


def fill_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """NULL and NaN become 0 in all numeric columns, or in the subset."""
    numeric_columns = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.na.fill(0, subset=list(numeric_columns if subset is None else subset))


def fill_missing_process(df: DataFrame) -> DataFrame:
    """The same, but spectral columns keep their gaps."""
    numeric_columns = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return fill_missing(df, [c for c in process_columns(df) if c in numeric_columns])


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns to double; text that is no number becomes 0."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return _rewrite(df, text if columns is None else columns, numeric.coerce_number)


def clean_nonfinite(df: DataFrame, column: str, count_as: str = "n_replaced") -> DataFrame:
    """NaN and infinities in a spectrum become 0; adds how many there were."""
    spectrum = F.col(column)
    return df.withColumns({column: arrays.fill_nonfinite(spectrum), count_as: arrays.count_nonfinite(spectrum)})


def drop_all_zero(df: DataFrame, spectrum: str) -> DataFrame:
    return df.where(arrays.has_signal(F.col(spectrum)))


def spectrum_quality(df: DataFrame, spectrum: str) -> DataFrame:
    """Adds the number of non-zero and of distinct points, and whether the spectrum is usable."""
    nonzero, distinct = arrays.count_nonzero(F.col(spectrum)), arrays.count_distinct(F.col(spectrum))
    return df.withColumns(
        {"n_nonzero": nonzero, "n_distinct": distinct, "usable": (nonzero > 0) & (distinct > 1)}
    )


def validate_length(df: DataFrame, key: str, spectrum: str, length: int) -> DataFrame:
    """Adds ``reason``: NULL for a valid row, else which sample has how many values."""
    size = F.coalesce(F.size(spectrum), F.lit(0))
    message = F.format_string(f"Spectrum %s has %d values, expected {length}", F.col(key).cast("string"), size)
    return df.withColumn("reason", F.when(size != length, message))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows of :func:`validate_length`."""
    return df.where(F.col("reason").isNull()).drop("reason"), df.where(F.col("reason").isNotNull())
