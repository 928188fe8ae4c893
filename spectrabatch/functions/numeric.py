"""Scalar column expressions: rounding, time, bins, bands, coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the target application accepts as a decimal number and as
# an infinite one. Java's parser would also take "1.5d" or hexadecimal floats.
DECIMAL_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(inf|infinity)\s*$"

# Bounds of the confidence bands.
HIGH_CONFIDENCE_MAX = 40.0
MEDIUM_CONFIDENCE_MAX = 60.0


def rounded(value: Column, digits: int = 6) -> Column:
    """Round half up; adding 0.0 turns a negative zero into zero."""
    return F.round(value, digits) + F.lit(0.0)


def rounded_half_even(value: Column, digits: int = 2) -> Column:
    """Scale, round half to even, scale back: how the scoring service rounds its doubles.

    ``bround`` works on the decimal digits instead and differs for values like 8.155,
    which as a double lies below the tie.
    """
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale + F.lit(0.0)


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours as double, independent of the session time zone."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)").cast("double")
    return seconds / F.lit(3600.0)


def finite_or_zero(value: Column) -> Column:
    """NULL, NaN and both infinities become 0."""
    value = value.cast("double")
    return F.when(is_nonfinite(value) | value.isNull(), F.lit(0.0)).otherwise(value)


def is_nonfinite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def missing_to_zero(value: Column) -> Column:
    """NULL and NaN become 0; infinities stay."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def coerce_number(text: Column) -> Column:
    """Text to double; whatever is not a number becomes 0."""
    sign = F.when(F.trim(text).startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return (
        F.when(text.rlike(DECIMAL_PATTERN), F.trim(text).try_cast("double"))
        .when(F.lower(text).rlike(INFINITY_PATTERN), sign * F.lit(float("inf")))
        .otherwise(F.lit(0.0))
    )


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """The ``bins + 1`` edges of equal-width bins."""
    width = (high - low) / bins
    return [low + i * width for i in range(bins)] + [high]


def closed_bin(value: Column, low: float | None, high: float | None, bins: int) -> Column:
    """1-based equal-width bin ``[edge, next edge)``; the last one includes the maximum.

    The quotient only guesses the bin, since a division may round across an
    edge; comparing with the two edges around the guess settles it. The cost
    does not grow with the number of bins. A constant column has a single bin.
    """
    if low is None or high is None or not high > low:
        return F.when(value.isNotNull(), F.lit(1)).cast("long")
    start, width = F.lit(float(low)), F.lit((high - low) / bins)
    guess = F.floor((value - start) / width)
    exact = (
        F.when(value < start + guess * width, guess - 1)
        .when(value >= start + (guess + 1) * width, guess + 1)
        .otherwise(guess)
    )
    inside = F.least(F.greatest(exact, F.lit(0)), F.lit(bins - 1)) + 1
    return F.when(value.isNotNull(), inside).cast("long")


def half_open_bin(value: Column, low: float | None, high: float | None, bins: int) -> Column:
    """Like :func:`closed_bin`, but the maximum falls outside: ``bins + 1`` there, 0 below the range."""
    if low is None or high is None or not high > low:
        return closed_bin(value, low, high, bins)
    outside = F.when(value >= F.lit(float(high)), F.lit(bins + 1).cast("long")).when(
        value < F.lit(float(low)), F.lit(0).cast("long")
    )
    return outside.otherwise(closed_bin(value, low, high, bins))


def confidence_band(prediction: Column) -> Column:
    """high for [0, 40], medium for (40, 60], low for anything else."""
    return (
        F.when((prediction >= 0) & (prediction <= HIGH_CONFIDENCE_MAX), "high")
        .when((prediction > HIGH_CONFIDENCE_MAX) & (prediction <= MEDIUM_CONFIDENCE_MAX), "medium")
        .otherwise("low")
    )


def order_hash(key: str, seed: int) -> Column:
    """A pseudo-random but repeatable order key: the hexadecimal MD5 of key and seed."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
