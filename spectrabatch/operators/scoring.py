"""Linear models on spectra: prediction, folded preprocessing, batch scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, numeric, stencils
from ..functions.stencils import SpectralSteps
from .cleaning import validate_length


@dataclass(frozen=True)
class LinearModel:
    """``intercept + sum(coefficients * features)``."""

    name: str
    coefficients: tuple[float, ...]
    intercept: float = 0.0

    def predict(self, features: Column) -> Column:
        return arrays.dot(features, arrays.literal(self.coefficients)) + F.lit(float(self.intercept))


def fold_preprocessing(
    model: LinearModel,
    axis: Sequence[float],
    steps: SpectralSteps,
    means: Sequence[float] | None = None,
    divisors: Sequence[float] | None = None,
) -> LinearModel:
    """The same model on the raw spectrum.

    Baseline, smoothing, derivative and scaling are affine, so they fold into
    weights once on the driver. Scoring is then one dot product per row
    instead of the whole chain.
    """
    start, stop = arrays.axis_range(axis, steps.low, steps.high)
    weights = np.asarray(model.coefficients, dtype=float)
    intercept = model.intercept
    if divisors is not None:
        weights = weights / np.asarray(divisors, dtype=float)
    if means is not None:
        intercept -= float(weights @ np.asarray(means, dtype=float))
    raw = stencils.folded_weights(len(axis), start, stop, steps, weights)
    return replace(model, coefficients=tuple(float(v) for v in raw), intercept=float(intercept))


def linear_score(df: DataFrame, spectrum: str, model: LinearModel, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, model.predict(arrays.fill_missing(F.col(spectrum))))


def score_models(df: DataFrame, spectrum: str, models: dict[str, LinearModel | None]) -> DataFrame:
    """One prediction column per model; a model that is not available gives NULL."""
    cleaned = df.withColumn("_x", arrays.fill_missing(F.col(spectrum)))
    predictions = {
        name: F.lit(None).cast("double") if model is None else model.predict(F.col("_x"))
        for name, model in models.items()
    }
    return cleaned.withColumns(predictions).drop("_x")


def batch_scoring(df: DataFrame, key: str, spectrum: str, model: LinearModel) -> DataFrame:
    """Validate, clean, score, round and band. Rows of wrong length carry a reason instead."""
    checked = validate_length(df, key, spectrum, len(model.coefficients))
    score = F.when(F.col("reason").isNull(), model.predict(arrays.fill_missing(F.col(spectrum))))
    scored = checked.withColumn("_score", score)
    return scored.select(
        key,
        numeric.rounded_half_even(F.col("_score"), 2).alias("predicted_concentration"),
        F.lit(model.name).alias("model_used"),
        F.when(F.col("reason").isNull(), numeric.confidence_band(F.col("_score"))).alias("confidence"),
        "reason",
    )


def scoring_summary(scored: DataFrame) -> DataFrame:
    """What the batch reply reports beside the predictions."""
    return scored.groupBy("model_used").agg(
        F.count("predicted_concentration").alias("total_spectra"),
        F.count("reason").alias("rejected"),
    )
