"""The spectral steps as window queries over long rows (sample, position, value).

One shuffle by sample replaces the array functions. A window holds the points
of one sample, so its size is fixed by the instrument. Used where the data is
already long, and as an independent check of the array plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def range_cut(df: DataFrame, axis: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(axis).between(low, high))


def linear_baseline(df: DataFrame, sample: str, axis: str, value: str) -> DataFrame:
    ordered = W.partitionBy(sample).orderBy(axis)
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    share = (F.row_number().over(ordered) - 1) / F.greatest(F.count(F.lit(1)).over(whole) - 1, F.lit(1))
    return df.withColumn(value, F.col(value) - (first + (last - first) * share))


def stencil(df: DataFrame, sample: str, axis: str, value: str, taps: dict[int, float]) -> DataFrame:
    """Weighted neighbours; beyond the ends the end value is repeated."""
    ordered = W.partitionBy(sample).orderBy(axis)
    whole = ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.lit(0.0)
    for offset in sorted(taps):
        end = F.first(value).over(whole) if offset < 0 else F.last(value).over(whole)
        total = total + F.coalesce(F.lead(value, offset).over(ordered), end) * F.lit(taps[offset])
    return df.withColumn(value, total)


def standard_scale(df: DataFrame, axis: str, value: str) -> DataFrame:
    """Statistics per point joined back; they hold one row per point."""
    stats = df.groupBy(axis).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    divisor = F.when(F.col("_dev") > 0, F.col("_dev")).otherwise(F.lit(1.0))
    return df.join(stats, axis).withColumn(value, (F.col(value) - F.col("_mean")) / divisor).drop("_mean", "_dev")
