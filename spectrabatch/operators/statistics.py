"""Profiles, per-batch statistics, histograms and correlations.

All aggregates merge partial results, so a batch that holds a third of the
rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric
from . import profiles

QUARTILES = (0.25, 0.5, 0.75)


def per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One row per column with the given aggregates, from one pass without a shuffle by column."""
    wide = df.agg(
        *[
            F.struct(F.lit(c).alias("variable"), *[m(F.col(c)).alias(name) for name, m in measures.items()]).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))


def _with_ends(shares: Sequence[float]) -> dict:
    """Measures that bracket the quantiles of a column within the same scan as its other facts."""
    value = lambda c: c.cast("double")
    return {
        "nan": lambda c: F.count_if(F.isnan(value(c))),
        "ends": lambda c: profiles.bracket_column(
            F.kll_sketch_agg_double(value(c), F.lit(profiles.SKETCH_SIZE)), shares, F.count(c) - F.count_if(F.isnan(value(c)))
        ),
    }


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, exact quartiles and maximum of every column, from two scans."""
    basic = per_column(
        df,
        columns,
        {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, **_with_ends(QUARTILES)},
    )
    facts = basic.collect()  # one row per column
    found = profiles.quantiles(df, facts, QUARTILES)
    names = [f"p{int(share * 100)}" for share in QUARTILES]
    rows = [
        (f["variable"], f["n"], f["mean"], f["std"], f["min"], f["max"], *[found.get((f["variable"], share)) for share in QUARTILES])
        for f in facts
    ]
    shown = basic.schema
    kept = [T.StructField("count" if name == "n" else name, shown[name].dataType) for name in ("variable", "n", "mean", "std", "min", "max")]
    return df.sparkSession.createDataFrame(rows, T.StructType([*kept, *[T.StructField(name, T.DoubleType()) for name in names]]))


def target_overview(df: DataFrame, target: str) -> DataFrame:
    """One row: count, min, max, mean, sample deviation and exact median, from two scans."""
    basic = per_column(df, [target], {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp, **_with_ends([0.5])})
    fact = basic.first()
    median = profiles.quantiles(df, [fact], [0.5]).get((target, 0.5))
    names = ["n", "min", "max", "mean", "std"]
    schema = T.StructType([T.StructField(name, basic.schema[name].dataType) for name in names] + [T.StructField("median", T.DoubleType())])
    return df.sparkSession.createDataFrame([(*[fact[name] for name in names], median)], schema)


def batch_stats(df: DataFrame, batch: str, target: str, time: str) -> DataFrame:
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(target).alias("avg_target"),
        F.stddev_samp(target).alias("std_target"),
        F.min(target).alias("min_target"),
        F.max(target).alias("max_target"),
        F.min(time).alias("min_time"),
        F.max(time).alias("max_time"),
    )


def batch_keys(df: DataFrame, batch: str) -> DataFrame:
    return df.select(batch).distinct().orderBy(batch)


def batch_select(df: DataFrame, batch: str, keys: Sequence) -> DataFrame:
    """Rows of the chosen batches in one scan; the predicate reaches the file reader."""
    return df.where(F.col(batch).isin(list(keys)))


def trajectories(df: DataFrame, batch: str, time: str, variable: str) -> DataFrame:
    """(batch, time, value) ready for plotting, sorted over the whole table."""
    return df.select(batch, time, variable).orderBy(batch, time)


def trajectory_buckets(df: DataFrame, batch: str, time: str, variable: str, width: float) -> DataFrame:
    """The same averaged per time bucket: plotting needs no more points than pixels."""
    bucket = F.floor(F.col(time) / F.lit(float(width))).cast("long")
    return df.groupBy(batch, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(variable).alias("avg_value")
    )


def value_ranges(df: DataFrame, columns: Sequence[str]) -> list[tuple[float | None, float | None]]:
    """Minimum and maximum of each column: one row, fetched so that bin edges become literals."""
    bounds = [f(c).cast("double").alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("low", F.min), ("high", F.max))]
    row = df.agg(*bounds).first()
    return [(row[f"low{i}"], row[f"high{i}"]) for i in range(len(columns))]


def value_range(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    return value_ranges(df, [column])[0]


def histogram(df: DataFrame, column: str, bins: int, groups: Sequence[str] = (), known: tuple | None = None) -> DataFrame:
    """Counts per equal-width bin over the range of the whole column; the last bin is closed.

    A range that is ``known``, for instance from a profile store, saves a scan.
    """
    number = numeric.closed_bin(F.col(column), *(known or value_range(df, column)), bins)
    return df.where(F.col(column).isNotNull()).groupBy(*groups, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def multi_histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Histograms of several columns, each over its own range, in one pass."""
    binned = df.select(
        *[
            numeric.closed_bin(F.col(c), low, high, bins).alias(c)
            for c, (low, high) in zip(columns, value_ranges(df, columns))
        ]
    )
    long = binned.unpivot([], list(columns), "variable", "bin").where(F.col("bin").isNotNull())
    return long.groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"))


def threshold_counts(df: DataFrame, column: str, thresholds: Sequence[float]) -> DataFrame:
    """One row: how many values exceed each threshold, and how many lie in the reported bands."""
    value = F.col(column)
    above = [F.count_if(value > t).alias(f"above_{t:g}".replace(".", "_")) for t in thresholds]
    # Bands of the summary, the last one closed at both ends.
    low = F.count_if((value >= 0) & (value < 5)).alias("band_low")
    medium = F.count_if((value >= 5) & (value < 15)).alias("band_medium")
    high = F.count_if((value >= 15) & (value <= 25)).alias("band_high")
    return df.agg(*above, low, medium, high)


def bin_population(chosen: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows of the chosen set per half-open bin of earlier edges; empty bins are kept.

    One pass counts all bins side by side, so no join is needed to add the empty ones.
    """
    binned = chosen.select(numeric.half_open_bin(F.col(column), low, high, bins).alias("bin"))
    counts = binned.agg(*[F.count_if(F.col("bin") == b).alias(f"n{b}") for b in range(1, bins + 1)])
    edges = numeric.bin_edges(low, high, bins)
    rows = [
        F.struct(
            F.lit(b).cast("long").alias("bin"),
            F.lit(edges[b - 1]).alias("bin_low"),
            F.lit(edges[b]).alias("bin_high"),
            F.col(f"n{b}").alias("n"),
        )
        for b in range(1, bins + 1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def target_correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of every column with the target, strongest first, in one pass."""
    rows = per_column(df, columns, {"correlation": lambda c: F.corr(c, F.col(target))})
    return rows.orderBy(F.abs("correlation").desc_nulls_last(), "variable")


def series_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Common minimum and maximum of several columns (plot limits)."""
    return df.agg(
        F.least(*[F.min(c) for c in columns]).alias("min_value"),
        F.greatest(*[F.max(c) for c in columns]).alias("max_value"),
    )
