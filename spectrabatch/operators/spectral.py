"""Spectral preprocessing on array columns.

Pointwise steps are higher-order functions. For the stencils the caller chooses
between two plans with equal results: NumPy over Arrow batches (the default), and
shifted array copies inside the JVM (``plan="array"``), whose interpreted lambdas
cost about 0.1 microseconds per point and tap (see README, "Measured choices").
Neither plan shuffles.

Both plans treat input alike: a NULL spectrum stays NULL, a missing point counts
as NaN and spreads to the points its window reaches, and a spectrum of another
length than the axis is an error; send such rows aside first
(``cleaning.validate_length``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, stencils
from ..functions.stencils import SpectralSteps


def range_cut(df: DataFrame, spectrum: str, axis: Sequence[float], low: float, high: float) -> tuple[DataFrame, list[float]]:
    """Keep the points with ``low <= axis <= high``; returns the cut axis as well."""
    start, stop = arrays.axis_range(axis, low, high)
    cut = df.withColumn(spectrum, arrays.position_slice(F.col(spectrum), start, stop))
    return cut, list(axis[start:stop])


def linear_baseline(df: DataFrame, spectrum: str, points: int) -> DataFrame:
    return df.withColumn(spectrum, arrays.subtract_end_line(F.col(spectrum), points))


def savgol_smooth(df: DataFrame, spectrum: str, points: int, window: int = 5, order: int = 2, plan: str = "arrow") -> DataFrame:
    return _stencils(df, spectrum, points, [stencils.savgol_taps(window, order)], plan)


def norris_williams(df: DataFrame, spectrum: str, points: int, segment: int = 3, gap: int = 2, plan: str = "arrow") -> DataFrame:
    """Segment mean, then the slope over ``gap`` points to either side."""
    return _stencils(df, spectrum, points, [stencils.segment_taps(segment), stencils.gap_taps(gap)], plan)


def _stencils(df: DataFrame, spectrum: str, points: int, sequence: list[dict[int, float]], plan: str) -> DataFrame:
    if plan == "array":
        df = df.withColumn(spectrum, arrays.of_length(F.col(spectrum), points))
        for taps in sequence:
            df = _stencil(df, spectrum, taps, points)
        return df

    def smooth(block: np.ndarray) -> np.ndarray:
        for taps in sequence:
            block = stencils.apply_taps(block, taps)
        return block

    return map_spectra(df, spectrum, points, smooth)


def _stencil(df: DataFrame, spectrum: str, taps: dict[int, float], points: int) -> DataFrame:
    """Beyond the ends the end value is repeated. The padded copy is a column of its own:
    it is used once per tap, and array functions would build it anew each time."""
    margin = max(abs(offset) for offset in taps)
    padded = df.withColumn("_padded", arrays.replicate_ends(F.col(spectrum), margin))
    return padded.withColumn(spectrum, arrays.shifted_sum(F.col("_padded"), taps, points)).drop("_padded")


def preprocess(
    df: DataFrame, spectrum: str, axis: Sequence[float], steps: SpectralSteps = SpectralSteps(), plan: str = "arrow"
) -> tuple[DataFrame, list[float]]:
    """Range cut, baseline, smoothing and derivative: the chain before scaling.

    ``plan="array"`` stays inside the JVM. It is the slower one for wide
    spectra, and a later filter on the result is pushed through all its levels.
    """
    start, stop = arrays.axis_range(axis, steps.low, steps.high)
    cleaned = df.withColumn(spectrum, arrays.fill_missing(F.col(spectrum)))
    if plan == "arrow":
        out = map_spectra(cleaned, spectrum, len(axis), lambda block: stencils.apply_steps(block, start, stop, steps))
        return out, list(axis[start:stop])
    points = stop - start
    cleaned = cleaned.withColumn(spectrum, arrays.of_length(F.col(spectrum), len(axis)))
    out, cut_axis = range_cut(cleaned, spectrum, axis, steps.low, steps.high)
    out = linear_baseline(out, spectrum, points)
    for taps in steps.tap_sequence():
        out = _stencil(out, spectrum, taps, points)
    return out, cut_axis


def map_spectra(df: DataFrame, spectrum: str, points: int, function) -> DataFrame:
    """Apply ``function`` on (rows x points) blocks, Arrow batch by Arrow batch.

    The other columns pass through untouched. NULL spectra stay NULL; one of
    another length raises an error, so values never cross between samples.
    """
    schema = T.StructType(
        [T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == spectrum else f.dataType) for f in df.schema]
    )
    position = df.columns.index(spectrum)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[position] = _map_list(columns[position], points, function)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.withColumn(spectrum, arrays.as_double(F.col(spectrum))).mapInArrow(run, schema)


def _map_list(column: pa.ListArray, points: int, function) -> pa.ListArray:
    present = column.is_valid().to_numpy(zero_copy_only=False)
    lists = column.drop_null()
    lengths = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
    if any(n != points for n in lengths):
        raise ValueError(f"spectra of {sorted(int(n) for n in lengths)} points, expected {points}")
    flat = lists.flatten()
    block = flat.to_numpy(zero_copy_only=False).reshape(int(present.sum()), points)
    result = np.ascontiguousarray(function(block))
    width = result.shape[1]
    ends = np.concatenate([[0], np.cumsum(np.where(present, width, 0))]).astype(np.int32)
    mask = pa.array(~present) if not present.all() else None
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(result.ravel()), mask=mask)


def explode_points(df: DataFrame, keys: Sequence[str], spectrum: str, value: str) -> DataFrame:
    """One row per point with its 0-based ``_pos``; NULL and empty spectra give none.

    The inner generator would make the optimizer push ``size(spectrum) > 0``
    through the whole chain of array steps, copying it at every level.
    """
    rows = df.select(*keys, F.posexplode_outer(arrays.as_double(F.col(spectrum))).alias("_pos", value))
    return rows.where(F.col("_pos").isNotNull())


def axis_statistics(df: DataFrame, spectrum: str) -> DataFrame:
    """One row per point: mean and population deviation over all samples.

    Exploding feeds a hash aggregate that keeps one entry per point in every
    task, so only ``tasks x points`` partial rows are shuffled.
    """
    return (
        explode_points(df, [], spectrum, "value")
        .groupBy(F.col("_pos").alias("pos"))
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    )


@dataclass(frozen=True)
class Scaler:
    """Fitted mean and divisor of every point."""

    means: tuple[float, ...]
    divisors: tuple[float, ...]

    def transform(self, df: DataFrame, spectrum: str) -> DataFrame:
        means, divisors = arrays.literal(self.means), arrays.literal(self.divisors)
        return df.withColumn(spectrum, arrays.standardise(arrays.as_double(F.col(spectrum)), means, divisors))


def fit_scaler(df: DataFrame, spectrum: str) -> Scaler:
    """Fit on training rows; one row per point comes to the driver. A constant point is divided by 1."""
    rows = axis_statistics(df, spectrum).orderBy("pos").collect()
    return Scaler(tuple(r["mean"] for r in rows), tuple(r["deviation"] or 1.0 for r in rows))


def standard_scale(df: DataFrame, spectrum: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation per point, fitted on ``fitted_on`` (default: ``df``).

    The fitted numbers enter the plan as literals: the data itself is not shuffled.
    """
    return fit_scaler(df if fitted_on is None else fitted_on, spectrum).transform(df, spectrum)


def scale_blocks(df: DataFrame, blocks: Sequence[str], out: str, fitted_on: DataFrame | None = None) -> DataFrame:
    """Scale every block on its own and concatenate them (process block first).

    The blocks are scaled point by point, so one fit over the concatenation
    serves all of them.
    """
    whole = F.concat(*[arrays.as_double(F.col(b)) for b in blocks])
    joined = df.withColumn(out, whole)
    scaler = fit_scaler(joined if fitted_on is None else fitted_on.withColumn(out, whole), out)
    return scaler.transform(joined, out)


def network_inputs(df: DataFrame, process: str, spectrum: str, length: int) -> DataFrame:
    """The pair of inputs of a two-branch model: process block and fixed-length spectrum."""
    return df.withColumn(process, arrays.fill_missing(F.col(process))).withColumn(
        spectrum, arrays.pad_or_truncate(arrays.fill_missing(F.col(spectrum)), length)
    )


def to_long(df: DataFrame, keys: Sequence[str], spectrum: str, axis: Sequence[float], value: str = "intensity") -> DataFrame:
    """One row per sample and point: keys, ``wl`` and the value."""
    exploded = explode_points(df, keys, spectrum, value)
    return exploded.select(*keys, F.get(arrays.literal(axis), F.col("_pos")).alias("wl"), value)


def wide_to_long(df: DataFrame, keys: Sequence[str], spectral: Sequence[str], value: str = "intensity") -> DataFrame:
    """The same from one column per wavenumber."""
    long = df.unpivot(list(keys), list(spectral), "_wl", value)
    return long.select(*keys, F.col("_wl").cast("double").alias("wl"), value)


def pack_spectrum(df: DataFrame, spectral: Sequence[str], out: str = "spectrum") -> tuple[DataFrame, list[float]]:
    """Wide columns to one array with ascending axis; done once when the data is read."""
    ordered = sorted(spectral, key=float)
    rest = [c for c in df.columns if c not in set(spectral)]
    quoted = ["`" + c.replace("`", "``") + "`" for c in ordered]
    packed = F.array(*[F.col(c).cast("double") for c in quoted]).alias(out)
    return df.select(*["`" + c.replace("`", "``") + "`" for c in rest], packed), [float(c) for c in ordered]


def batch_mean_spectrum(df: DataFrame, batch: str, spectrum: str, axis: Sequence[float]) -> DataFrame:
    """Mean spectrum of every batch; partial sums leave ``batches x points`` rows per task."""
    long = explode_points(df, [batch], spectrum, "_v")
    means = long.groupBy(batch, "_pos").agg(F.avg("_v").alias("mean_intensity"))
    return means.select(batch, F.get(arrays.literal(axis), F.col("_pos")).alias("wl"), "mean_intensity")


def transposed(df: DataFrame, spectrum: str, axis: Sequence[float], column_key: str, keys: Sequence[int]) -> DataFrame:
    """One row per axis point, one column per key of the given, bounded list; the mean where a key repeats."""
    long = to_long(df.where(F.col(column_key).isin(list(keys))), [column_key], spectrum, axis)
    pivoted = long.groupBy("wl").pivot(column_key, list(keys)).agg(F.avg("intensity"))
    return pivoted.select("wl", *[F.col(f"`{k}`").alias(f"s_{k}") for k in keys])


TRANSPOSED_ROWS = 10_000  # a row becomes a column of the plan


def transpose_rows(df: DataFrame, key: str, first: int, last: int, spectrum: str, axis: Sequence[float], low: float, high: float) -> DataFrame:
    """The rows with keys first..last and the points low..high, turned around: one column per key.

    The keys come from the data, so none is lost; a key that occurs twice is an
    error, and so are more rows than a plan can hold as columns.
    """
    rows = df.where(F.col(key).between(first, last))
    keys = [r[key] for r in rows.select(key).limit(TRANSPOSED_ROWS + 1).collect()]
    if len(keys) > TRANSPOSED_ROWS or len(set(keys)) < len(keys):
        raise ValueError(f"a transpose to columns needs unique keys, at most {TRANSPOSED_ROWS}; tiles.tiled takes any number")
    cut, cut_axis = range_cut(rows, spectrum, axis, low, high)
    return transposed(cut, spectrum, cut_axis, key, sorted(keys))
