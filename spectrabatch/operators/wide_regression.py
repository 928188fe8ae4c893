"""PLS and ElasticNet for any number of features.

The fits of ``regression`` add up one features x features matrix. Here only vectors
as long as the feature array leave a task: each step is a pass that multiplies
Arrow batches by a vector and sums X'(X v) in two levels. The driver holds a few
vectors, and for ElasticNet the cross products of the features in use.

Every pass reads the input again, so write or persist it first if it is costly to
make. Rows, gaps and lengths are checked as in ``regression.centre_of``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regression
from .regression import FIRST_LEVEL, Centre, NotConverged
from .scoring import LinearModel

#: Bytes of features that one Arrow batch should hold.
BATCH_BYTES = 32 << 20
ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, width: int) -> Iterator[None]:
    """Arrow batches of bounded bytes while the block runs: rows per batch follow the width."""
    before = spark.conf.get(ROWS_SETTING)
    allowed = int(before) if int(before) > 0 else 10_000  # zero and less mean no limit
    spark.conf.set(ROWS_SETTING, max(1, min(allowed, BATCH_BYTES // (8 * width))))
    try:
        yield
    finally:
        spark.conf.set(ROWS_SETTING, before)


class Passes:
    """Sums over the rows of a table, one vector per pass."""

    def __init__(self, df: DataFrame, features: str, label: str):
        self.width, self.mean_y = regression.checked(df, features, label)
        self.df, self.features, self.label = df, features, label
        # no centre yet: the first pass takes the means, the second the centred squares and products
        sums = self.total(lambda x, y: np.append(x.sum(axis=0), len(y)), np.zeros(self.width), 0.0)
        self.n = sums[-1]
        self.mean_x = sums[:-1] / self.n
        squares = self.total(lambda x, y: np.concatenate([(x * x).sum(axis=0), y @ x, [y @ y]]))
        self.xx, self.xy, self.yy = squares[: self.width], squares[self.width : -1], float(squares[-1])

    def total(self, of: Callable[[np.ndarray, np.ndarray], np.ndarray], mean_x: np.ndarray | None = None, mean_y: float | None = None) -> np.ndarray:
        """Sum of ``of(x, y)`` over blocks of centred rows."""
        mean_x = self.mean_x if mean_x is None else mean_x
        mean_y = self.mean_y if mean_y is None else mean_y

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(mean_x))
                    added = of(x - mean_x, batch.column(1).to_numpy() - mean_y)
                    found = added if found is None else found + added
            if found is not None:
                part = TaskContext.get().partitionId() % FIRST_LEVEL
                yield pa.record_batch([pa.array([part], pa.int64()), pa.array([found], pa.list_(pa.float64()))], ["part", "v"])

        rows = regression._narrow(self.df, self.features, self.label, None).select("x", "y")
        added = Summarizer.sum(array_to_vector("v")).alias("v")
        parts = rows.mapInArrow(partial, "part long, v array<double>").groupBy("part").agg(added).select(vector_to_array("v").alias("v"))
        with batches_of(self.df.sparkSession, self.width):
            return np.array(parts.agg(added).select(vector_to_array("v")).first()[0])

    def image(self, v: np.ndarray) -> np.ndarray:
        """X'(X v) of the centred features."""
        return self.total(lambda x, y: (x @ v) @ x)

    def products(self, columns: list[int]) -> np.ndarray:
        """Cross products of some centred features and the label."""
        centre = Centre(self.width, self.mean_x, self.mean_y)
        with batches_of(self.df.sparkSession, self.width):
            return regression.products_by_fold(self.df, self.features, self.label, centre=centre, columns=columns)[0]

    def model(self, name: str, coefficients: np.ndarray) -> LinearModel:
        return LinearModel(name, tuple(float(c) for c in coefficients), float(self.mean_y - self.mean_x @ coefficients))


def fit_pls(df: DataFrame, features: str, label: str, components: int = 10, name: str = "PLS") -> LinearModel:
    """The model of ``regression.fit_pls``; two passes and one more per component."""
    passes = Passes(df, features, label)
    divisor = max(passes.n - 1, 1)
    spread_x = np.sqrt(passes.xx / divisor)
    spread_x = np.where(spread_x > 1e-10 * np.maximum(np.abs(passes.mean_x), 1.0), spread_x, 1.0)
    spread_y = np.sqrt(passes.yy / divisor) or 1.0
    slope = np.zeros(passes.width)
    for slope in regression.latent_slopes(passes.xy / (spread_x * spread_y), lambda r: passes.image(r / spread_x) / spread_x, components):
        pass
    return passes.model(name, slope * spread_y / spread_x)


def fit_elasticnet(
    df: DataFrame, features: str, label: str, alpha: float, l1_ratio: float, name: str = "ElasticNet",
    tol: float = 1e-10, most: int | None = None, max_passes: int = 2000,
) -> LinearModel:
    """The minimum of ``regression.fit_elasticnet_moments``.

    Features enter by the optimality condition: a pass takes the gradient of all of
    them, those that break the condition join the working set (which at most doubles),
    and the problem is solved exactly on the cross products of the working set. It
    ends when a pass finds no feature outside that breaks the condition. Should more
    than ``most`` features (``regression.MAX_FEATURES``) be needed, accelerated
    proximal gradient steps on all features go on from there.
    """
    passes = Passes(df, features, label)
    most = regression.MAX_FEATURES if most is None else most
    absolute, squared = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    w, working = np.zeros(passes.width), []
    gradient = passes.xy / passes.n
    slack = tol * max(np.abs(gradient).max(initial=0.0), 1e-300)
    usable = passes.xx > 0
    while True:
        outside = np.ones(passes.width, bool)
        outside[working] = False
        broken = np.flatnonzero(outside & usable & (np.abs(gradient) > absolute + slack))
        if not len(broken):
            return passes.model(name, w)
        strongest = broken[np.argsort(-np.abs(gradient[broken]), kind="stable")][: max(64, len(working))]
        working = sorted({*np.flatnonzero(w).tolist(), *strongest.tolist()})
        if len(working) > most:
            return passes.model(name, _proximal(passes, w, absolute, squared, tol, max_passes))
        found, _ = regression.elasticnet_coefficients(passes.products(working), alpha, l1_ratio)
        w = np.zeros(passes.width)
        w[working] = found
        gradient = (passes.xy - passes.image(w)) / passes.n


def _proximal(passes: Passes, w: np.ndarray, absolute: float, squared: float, tol: float, max_passes: int) -> np.ndarray:
    """Accelerated proximal gradient; the momentum restarts when it points uphill."""
    step = 1.0 / (_largest_curvature(passes) + squared)
    ahead, momentum = w, 1.0
    for _ in range(max_passes):
        gradient = (passes.image(ahead) - passes.xy) / passes.n + squared * ahead
        moved = ahead - step * gradient
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * absolute, 0.0)
        if np.abs(new - ahead).max() <= tol * max(np.abs(new).max(), 1e-300):
            return new
        if (ahead - new) @ (new - w) > 0:
            momentum = 1.0
        following = (1.0 + np.sqrt(1.0 + 4.0 * momentum * momentum)) / 2.0
        ahead = new + (momentum - 1.0) / following * (new - w)
        w, momentum = new, following
    raise NotConverged(f"{max_passes} passes did not reach the tolerance {tol}; allow more passes or a larger penalty")


def _largest_curvature(passes: Passes, rounds: int = 30) -> float:
    """A bound just above the largest eigenvalue of X'X / n, by power iteration."""
    v = np.random.default_rng(0).normal(size=passes.width)
    value = 0.0
    for _ in range(rounds):
        v /= np.linalg.norm(v)
        image = passes.image(v) / passes.n
        before, value = value, float(np.linalg.norm(image))
        if value == 0.0 or abs(value - before) <= 1e-6 * value:
            break
        v = image
    return 1.05 * value
