"""Expressions over a spectrum held as ``array<double>`` (no shuffle, no Python)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numeric


def as_double(spectrum: Column) -> Column:
    return spectrum.cast("array<double>")


def of_length(spectrum: Column, points: int) -> Column:
    """The spectrum with missing points as NaN; an error if it has another length."""
    wrong = F.raise_error(F.format_string(f"a spectrum of %d points, expected {points}", F.size(spectrum))).cast("array<double>")
    filled = F.transform(as_double(spectrum), lambda v: F.coalesce(v, F.lit(float("nan"))))
    return F.when(spectrum.isNull(), F.lit(None)).when(F.size(spectrum) != points, wrong).otherwise(filled)


def fill_missing(spectrum: Column) -> Column:
    return F.transform(as_double(spectrum), numeric.missing_to_zero)


def fill_nonfinite(spectrum: Column) -> Column:
    return F.transform(as_double(spectrum), numeric.finite_or_zero)


def count_nonfinite(spectrum: Column) -> Column:
    return F.size(F.filter(as_double(spectrum), numeric.is_nonfinite)).cast("long")


def count_nonzero(spectrum: Column) -> Column:
    return F.size(F.filter(spectrum, lambda v: v != 0)).cast("long")


def count_distinct(spectrum: Column) -> Column:
    return F.size(F.array_distinct(spectrum)).cast("long")


def has_signal(spectrum: Column) -> Column:
    return F.exists(spectrum, lambda v: v != 0)


def pad_or_truncate(spectrum: Column, length: int) -> Column:
    """Exactly ``length`` points: zeros appended, or the tail cut off."""
    return F.slice(F.concat(as_double(spectrum), F.array_repeat(F.lit(0.0), length)), 1, length)


def position_slice(spectrum: Column, start: int, stop: int) -> Column:
    """Points ``start`` (0-based, included) to ``stop`` (excluded)."""
    return F.slice(spectrum, start + 1, stop - start)


def literal(values: Sequence[float]) -> Column:
    """Array constant. One parsed text is much faster to build than a call per number."""
    numbers = [float(v) for v in values]
    texts = [f"{v!r}D" if math.isfinite(v) else f"double('{v}')" for v in numbers]
    return F.expr(f"cast(array({', '.join(texts)}) as array<double>)")


def dot(spectrum: Column, weights: Column) -> Column:
    products = F.zip_with(spectrum, weights, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)


def axis_range(axis: Sequence[float], low: float, high: float) -> tuple[int, int]:
    """0-based ``[start, stop)`` of the axis points in ``[low, high]``; the axis ascends."""
    if any(b <= a for a, b in zip(axis, axis[1:])):
        raise ValueError("the axis has to ascend; sort it once when the data is read")
    inside = [i for i, point in enumerate(axis) if low <= point <= high]
    return (inside[0], inside[-1] + 1) if inside else (0, 0)


def sort_by_axis(spectrum: Column, axis: Sequence[float]) -> Column:
    """Permute the points so that their axis ascends; the order is found once on the driver."""
    order = sorted(range(len(axis)), key=lambda i: axis[i])
    return F.transform(F.lit(order), lambda i: F.get(spectrum, i))


def replicate_ends(spectrum: Column, margin: int) -> Column:
    return F.concat(
        F.array_repeat(F.get(spectrum, F.lit(0)), margin),
        spectrum,
        F.array_repeat(F.element_at(spectrum, -1), margin),
    )


def shifted_sum(padded: Column, taps: dict[int, float], points: int) -> Column:
    """``out[i] = sum(taps[j] * padded[i + margin + j])`` as shifted slices added up."""
    margin = max(abs(offset) for offset in taps)
    total = None
    for offset in sorted(taps):
        total = _add_shifted(total, F.slice(padded, offset + margin + 1, points), taps[offset])
    return total


def _add_shifted(total: Column | None, shifted: Column, tap: float) -> Column:
    if total is None:
        return F.transform(shifted, lambda v: v * F.lit(tap))
    return F.zip_with(total, shifted, lambda a, b: a + b * F.lit(tap))


def subtract_end_line(spectrum: Column, points: int) -> Column:
    """Subtract the straight line through the first and the last point."""
    first = F.get(spectrum, F.lit(0))
    slope = (F.element_at(spectrum, -1) - first) / F.lit(float(max(points - 1, 1)))
    return F.transform(spectrum, lambda v, i: v - (first + slope * i))


def standardise(spectrum: Column, means: Column, divisors: Column) -> Column:
    centred = F.zip_with(spectrum, means, lambda v, m: v - m)
    return F.zip_with(centred, divisors, lambda v, d: v / d)
