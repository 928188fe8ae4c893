"""ElasticNet and partial least squares.

Both need only the cross products of the features, and those add up over rows.
One distributed pass gathers them per fold; what remains is a problem of the
size of the feature matrix (features x features), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from .scoring import LinearModel

MAX_FEATURES = 4096  # the driver holds one features x features matrix per fold
FIRST_LEVEL = 64  # partial matrices are added up in that many groups first


class NotConverged(RuntimeError):
    """A fit used up its iterations before it met its tolerance."""


def elasticnet_penalty(alpha: float, l1_ratio: float, label_deviation: float) -> tuple[float, float]:
    """(regParam, elasticNetParam) for the objective ``RSS/2n + alpha*l1*|w| + alpha*(1-l1)/2*|w|^2``.

    Spark divides the label by its deviation first, which changes the weight
    of the squared term but not of the absolute one.
    """
    absolute = alpha * l1_ratio
    total = absolute + alpha * (1.0 - l1_ratio) * label_deviation
    return (total, absolute / total) if total > 0 else (0.0, 0.0)


def fit_elasticnet(
    df: DataFrame, features: str, label: str, alpha: float = 1.0, l1_ratio: float = 0.5,
    max_iter: int = 1000, tol: float = 1e-9,
) -> LinearRegressionModel:
    """Fit on features that are already scaled."""
    deviation = df.agg(F.stddev_pop(label)).first()[0] or 0.0
    strength, mix = elasticnet_penalty(alpha, l1_ratio, deviation)
    vectors = df.select(array_to_vector(arrays.as_double(F.col(features))).alias(features), F.col(label).cast("double"))
    estimator = LinearRegression(
        featuresCol=features, labelCol=label, regParam=strength, elasticNetParam=mix,
        standardization=False, maxIter=max_iter, tol=tol,
    )
    fitted = estimator.fit(vectors)
    if strength > 0 and mix > 0 and fitted.summary.totalIterations >= max_iter:
        raise NotConverged(f"{max_iter} iterations did not reach the tolerance {tol}")
    return fitted


def as_linear_model(fitted: LinearRegressionModel, name: str = "ElasticNet") -> LinearModel:
    return LinearModel(name, tuple(float(c) for c in fitted.coefficients), float(fitted.intercept))


def _narrow(df: DataFrame, features: str, label: str, fold: str | None) -> DataFrame:
    return df.select(
        (F.col(fold) if fold else F.lit(0)).cast("long").alias("fold"),
        arrays.as_double(F.col(features)).alias("x"),
        F.col(label).cast("double").alias("y"),
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())


@dataclass(frozen=True)
class Centre:
    """Width and means of features and label, from a first pass over the rows that take part."""

    width: int
    x: np.ndarray
    y: float


def centre_of(df: DataFrame, features: str, label: str) -> Centre:
    """Check the rows and take their means: one row per feature comes to the driver.

    Feature arrays of different lengths, missing or infinite numbers, and more
    than ``MAX_FEATURES`` columns raise an error before any matrix is built.
    """
    width, mean_y = checked(df, features, label)
    if width > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features; the fits of wide_regression hold no matrix of all features")
    rows = _narrow(df, features, label, None)
    means = rows.select(F.posexplode_outer("x").alias("i", "v")).where("i is not null").groupBy("i").agg(F.avg("v").alias("m")).collect()
    x = np.zeros(width)
    for r in means:
        x[r["i"]] = r["m"]
    return Centre(width, x, mean_y)


def checked(df: DataFrame, features: str, label: str) -> tuple[int, float]:
    """Width of the feature arrays and mean of the label, after the checks of :func:`centre_of` that need no width limit."""
    rows = _narrow(df, features, label, None)
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | F.isnan("y") | (F.abs("y") == float("inf"))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"),
        F.count_if(bad).alias("bad"), F.avg("y").alias("y"),
    ).first()
    if not facts["n"]:
        raise ValueError("no rows to fit")
    if facts["low"] != facts["high"]:
        raise ValueError(f"feature arrays of {facts['low']} to {facts['high']} numbers")
    if facts["bad"]:
        raise ValueError(f"{facts['bad']} rows with missing or infinite numbers; fill them first")
    return facts["high"], facts["y"]


def cross_products(
    df: DataFrame, features: str, label: str, fold: str | None = None, centre: Centre | None = None, columns: Sequence[int] | None = None
) -> DataFrame:
    """Rows ``(fold, i, products)`` of the matrix of ``[1, features, label]``, summed over the samples.

    Every input task multiplies Arrow batches into one matrix per fold and emits
    its rows; Spark adds them up in two levels, so no reducer meets the rows of
    all tasks. With ``centre`` its means are taken off first, which keeps the
    precision that subtracting large sums afterwards would lose. ``columns`` takes
    only these features.
    """
    offsets = None if centre is None else (centre.x, centre.y)
    partial = _narrow(df, features, label, fold).mapInArrow(lambda batches: _partial_products(batches, offsets, columns), "part long, fold long, i long, products array<double>")
    total = Summarizer.sum(array_to_vector("products")).alias("v")
    first = partial.groupBy("part", "fold", "i").agg(total).select("fold", "i", vector_to_array("v").alias("products"))
    return first.groupBy("fold", "i").agg(total).select("fold", "i", vector_to_array("v").alias("products"))


def _partial_products(
    batches: Iterable[pa.RecordBatch], offsets: tuple | None = None, columns: Sequence[int] | None = None
) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    width = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        fold, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        lengths = np.unique(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
        width = int(lengths[0]) if width is None else width
        if len(lengths) > 1 or lengths[0] != width:
            raise ValueError(f"feature arrays of {sorted({width, *map(int, lengths)})} numbers")
        flat = batch.column(1).flatten()
        if flat.null_count:
            raise ValueError("a feature array has missing numbers; fill them first")
        x = flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
        if offsets is not None:
            x, y = x - offsets[0], y - offsets[1]
        if columns is not None:
            x = x[:, columns]
        for f in np.unique(fold):
            rows = fold == f
            block = np.column_stack([np.ones(int(rows.sum())), x[rows], y[rows]])
            product = block.T @ block
            sums[int(f)] = sums[int(f)] + product if int(f) in sums else product
    part = TaskContext.get().partitionId() % FIRST_LEVEL
    for f, matrix in sums.items():
        size = matrix.shape[0]
        rows = pa.ListArray.from_arrays(
            pa.array(np.arange(0, size * size + 1, size, dtype=np.int32)), pa.array(matrix.ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, part, dtype=np.int64)), pa.array(np.full(size, f, dtype=np.int64)), pa.array(np.arange(size, dtype=np.int64)), rows],
            names=["part", "fold", "i", "products"],
        )


def products_by_fold(
    df: DataFrame, features: str, label: str, fold: str | None = None, centre: Centre | None = None, columns: Sequence[int] | None = None
) -> dict[int, np.ndarray]:
    """The summed matrices on the driver: ``folds x (features + 2)^2`` numbers; the width is checked first."""
    if centre is None:
        centre_of(df, features, label)
    table = cross_products(df, features, label, fold, centre, columns).orderBy("fold", "i").toArrow()
    matrices = {}
    for f in table["fold"].unique().to_pylist():
        rows = table.filter(pc.equal(table["fold"], f))["products"].combine_chunks()
        matrices[f] = rows.flatten().to_numpy().reshape(len(rows), -1)
    return matrices


def gram_matrix(df: DataFrame, features: str, label: str) -> DataFrame:
    """The cross products as rows ``(i, j, value)``; index 0 is the constant, the last one the label."""
    rows = cross_products(df, features, label)
    return rows.select("i", F.posexplode("products").alias("j", "value")).withColumn("j", F.col("j").cast("long"))


@dataclass(frozen=True)
class Moments:
    """Centred moments of a set of rows, taken from its cross products."""

    n: float
    mean_x: np.ndarray
    mean_y: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @staticmethod
    def of(products: np.ndarray) -> Moments:
        n, sums = products[0, 0], products[0, 1:]
        centred = products[1:, 1:] - np.outer(sums, sums) / n
        return Moments(n, sums[:-1] / n, sums[-1] / n, centred[:-1, :-1], centred[:-1, -1], centred[-1, -1])


def pls_coefficients(products: np.ndarray, components: int) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) for 1..components latent variables of one target.

    The kernel recursion of Dayal and MacGregor (1997): with a single target
    it deflates only the covariance vector. Columns and target are brought to
    unit sample deviation; a constant column keeps divisor 1.
    """
    m = Moments.of(products)
    spread_x = np.sqrt(np.maximum(np.diag(m.xx), 0.0) / max(m.n - 1, 1))
    noise = 1e-10 * np.maximum(np.abs(m.mean_x), 1.0)
    spread_x = np.where(spread_x > noise, spread_x, 1.0)
    spread_y = np.sqrt(max(m.yy, 0.0) / max(m.n - 1, 1)) or 1.0
    xx = m.xx / np.outer(spread_x, spread_x)
    xy = m.xy / (spread_x * spread_y)

    fitted = []
    for slope in latent_slopes(xy, lambda rotation: xx @ rotation, components):
        coefficients = slope * spread_y / spread_x
        fitted.append((coefficients, float(m.mean_y - m.mean_x @ coefficients)))
    return fitted


def latent_slopes(xy: np.ndarray, image_of: Callable[[np.ndarray], np.ndarray], components: int) -> Iterator[np.ndarray]:
    """Slopes of scaled data for 1..components latent variables; ``image_of(v)`` is X'(X v), asked for once per component."""
    start = np.linalg.norm(xy)
    rotations, loadings = [], []
    slope = np.zeros_like(xy)
    for _ in range(components):
        length = np.linalg.norm(xy)
        if length > 1e-12 * max(start, 1e-300):
            direction = xy / length
            rotation = direction - sum((p @ direction) * r for p, r in zip(loadings, rotations))
            image = image_of(rotation)
            variance = rotation @ image
            loading, gain = image / variance, (rotation @ xy) / variance
            xy = xy - loading * (gain * variance)
            rotations.append(rotation)
            loadings.append(loading)
            slope = slope + rotation * gain
        yield slope


def elasticnet_coefficients(
    products: np.ndarray, alpha: float, l1_ratio: float, sweeps: int = 10_000, tol: float = 1e-12
) -> tuple[np.ndarray, float]:
    """Coordinate descent on the moments: the same minimum as :func:`fit_elasticnet`, no pass over the data."""
    m = Moments.of(products)
    xx, xy = m.xx / m.n, m.xy / m.n
    absolute, squared = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    w = np.zeros_like(xy)
    gradient = xy.copy()
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(w)):
            if xx[j, j] <= 0:
                continue
            pull = gradient[j] + xx[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - absolute, 0.0) / (xx[j, j] + squared)
            change = new - w[j]
            if change:
                gradient -= xx[:, j] * change
                w[j] = new
                largest = max(largest, abs(change))
        if largest <= tol * max(np.abs(w).max(initial=0.0), 1e-300):
            return w, float(m.mean_y - m.mean_x @ w)
    raise NotConverged(f"{sweeps} sweeps did not reach the tolerance {tol}; allow more sweeps or a larger penalty")


def fit_elasticnet_moments(df: DataFrame, features: str, label: str, alpha: float, l1_ratio: float, name: str = "ElasticNet") -> LinearModel:
    """The fit of :func:`fit_elasticnet` from one pass over the data."""
    centre = centre_of(df, features, label)
    w, intercept = elasticnet_coefficients(products_by_fold(df, features, label, centre=centre)[0], alpha, l1_ratio)
    return LinearModel(name, tuple(float(c) for c in w), float(intercept + centre.y - centre.x @ w))


def fit_pls(df: DataFrame, features: str, label: str, components: int = 10, name: str = "PLS") -> LinearModel:
    """From centred products; the intercept is moved back to the features as they came."""
    centre = centre_of(df, features, label)
    coefficients, intercept = pls_coefficients(products_by_fold(df, features, label, centre=centre)[0], components)[-1]
    return LinearModel(name, tuple(float(c) for c in coefficients), float(intercept + centre.y - centre.x @ coefficients))


def r2_from_products(products: np.ndarray, coefficients: np.ndarray, intercept: float) -> float:
    """R2 of a linear model on the rows behind the cross products."""
    weights = np.concatenate([[-intercept], -coefficients, [1.0]])
    spread = Moments.of(products).yy
    return float(1.0 - (weights @ products @ weights) / spread) if spread > 0 else float("nan")


def standardised(products: np.ndarray, training: Moments) -> np.ndarray:
    """Cross products after scaling the features with the mean and deviation of the training rows."""
    deviation = np.sqrt(np.maximum(np.diag(training.xx), 0.0) / training.n)
    deviation = np.where(deviation > 1e-10 * np.maximum(np.abs(training.mean_x), 1.0), deviation, 1.0)
    change = np.eye(len(products))
    inner = np.arange(1, len(products) - 1)
    change[inner, inner] = 1.0 / deviation
    change[0, inner] = -training.mean_x / deviation
    return change.T @ products @ change


def cross_validate(
    df: DataFrame, features: str, label: str, fold: str,
    components: Sequence[int] = (), penalties: Sequence[tuple[float, float]] = (), scale_in_fold: bool = False,
) -> DataFrame:
    """R2 per fold for every PLS size and every ElasticNet (alpha, l1_ratio), from one pass.

    The training part of a fold is the total minus the fold, so neither a fold
    nor a grid point costs another pass. By default the features are taken as
    they come, scaled over all training rows or not at all; ``scale_in_fold``
    scales them with the training part of each fold. Each fold and penalty is a
    task of its own.
    """
    centre = centre_of(df, features, label)  # the same for all folds, so R2 does not change
    parts = products_by_fold(df, features, label, fold, centre)
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((parts, sum(parts.values())))  # folds + 1 matrices of bounded width
    jobs = [(f, "PLS", 0.0, 0.0) for f in sorted(parts) if components]
    jobs += [(f, "ElasticNet", float(a), float(r)) for f in sorted(parts) for a, r in penalties]
    sizes = list(components)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, total = sent.value
        for frame in frames:
            rows = []
            for f, kind, alpha, l1_ratio in frame.itertuples(index=False):
                held_out, training = parts[f], total - parts[f]
                if scale_in_fold:
                    moments = Moments.of(training)
                    training, held_out = standardised(training, moments), standardised(held_out, moments)
                if kind == "PLS":
                    path = pls_coefficients(training, max(sizes))
                    rows += [(f"PLS({size})", f, r2_from_products(held_out, *path[size - 1])) for size in sizes]
                else:
                    found = elasticnet_coefficients(training, alpha, l1_ratio)
                    rows.append((f"ElasticNet({alpha:g},{l1_ratio:g})", f, r2_from_products(held_out, *found)))
            yield pd.DataFrame(rows, columns=["model", "fold", "r2"])

    table = spark.createDataFrame(jobs, "fold long, kind string, alpha double, l1_ratio double").repartition(max(1, len(jobs)))
    return table.mapInPandas(fit, "model string, fold long, r2 double")


def cv_summary(fold_scores: DataFrame) -> DataFrame:
    """Mean, population deviation, minimum and maximum over the folds; best mean first."""
    return (
        fold_scores.groupBy("model")
        .agg(
            F.count("r2").alias("folds"),
            F.avg("r2").alias("cv_mean"),
            F.stddev_pop("r2").alias("cv_std"),
            F.min("r2").alias("cv_min"),
            F.max("r2").alias("cv_max"),
        )
        .orderBy(F.desc("cv_mean"), "model")
    )
