"""Fits without a matrix of all features against the fits that hold one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabatch.operators import regression, wide_regression


def table(spark, rows, width, seed=1, noise=0.1, offset=5.0):
    """Smooth, strongly correlated spectra whose first points drive the target."""
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=(rows, width)), axis=1) / np.sqrt(width) + rng.normal(size=(rows, width)) + offset
    y = x[:, ::7][:, :5] @ np.array([2.0, -1.0, 0.5, 1.5, -0.7]) + noise * rng.normal(size=rows)
    frame = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(4)
    return frame.persist(), x, y


@pytest.mark.parametrize("width", [64, 1400])
def test_pls_equals_the_moment_fit(spark, width):
    frame, *_ = table(spark, 150, width)
    for components in (1, 5):
        want, got = regression.fit_pls(frame, "x", "y", components), wide_regression.fit_pls(frame, "x", "y", components)
        np.testing.assert_allclose([got.intercept, *got.coefficients], [want.intercept, *want.coefficients], rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("width, alpha", [(64, 0.05), (64, 0.001), (1400, 0.1)])
def test_elasticnet_equals_the_moment_fit(spark, width, alpha):
    frame, *_ = table(spark, 150, width)
    want, got = (fit(frame, "x", "y", alpha, 0.5) for fit in (regression.fit_elasticnet_moments, wide_regression.fit_elasticnet))
    np.testing.assert_allclose([got.intercept, *got.coefficients], [want.intercept, *want.coefficients], rtol=1e-8, atol=1e-8)


def test_more_features_than_the_working_set_may_hold(spark):
    frame, *_ = table(spark, 80, 40, noise=1.0)
    want = regression.fit_elasticnet_moments(frame, "x", "y", 0.3, 0.2)
    got = wide_regression.fit_elasticnet(frame, "x", "y", 0.3, 0.2, most=2)
    np.testing.assert_allclose(got.coefficients, want.coefficients, atol=1e-7)
    with pytest.raises(regression.NotConverged):
        wide_regression.fit_elasticnet(frame, "x", "y", 0.3, 0.2, most=2, max_passes=2)


def test_twenty_thousand_features(spark):
    frame, x, y = table(spark, 60, 20_000, noise=0.01)
    with pytest.raises(ValueError, match="more than 4096 features"):
        regression.fit_pls(frame, "x", "y", 2)
    before = spark.conf.get(wide_regression.ROWS_SETTING)
    pls = wide_regression.fit_pls(frame, "x", "y", 3)
    fitted = x @ np.array(pls.coefficients) + pls.intercept
    assert 1 - ((y - fitted) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.95
    net = wide_regression.fit_elasticnet(frame, "x", "y", 0.5, 0.9)
    w = np.array(net.coefficients)
    gradient = (x - x.mean(0)).T @ (y - x @ w - net.intercept) / len(y)
    assert np.abs(gradient[w == 0]).max() <= 0.45 * (1 + 1e-8)
    np.testing.assert_allclose(gradient[w != 0], 0.45 * np.sign(w[w != 0]) + 0.05 * w[w != 0], atol=1e-8)
    assert 0 < (w != 0).sum() < 60 and spark.conf.get(wide_regression.ROWS_SETTING) == before


def test_constant_columns_and_bad_rows(spark):
    frame = spark.createDataFrame([([1.0, float(i), 7.0], 2.0 * i) for i in range(20)], "x array<double>, y double")
    for model in (wide_regression.fit_pls(frame, "x", "y", 2), wide_regression.fit_elasticnet(frame, "x", "y", 0.0, 0.5)):
        np.testing.assert_allclose(model.coefficients, [0.0, 2.0, 0.0], atol=1e-8)
    flat = frame.withColumn("y", F.lit(3.0))
    assert set(wide_regression.fit_elasticnet(flat, "x", "y", 0.1, 0.5).coefficients) == {0.0}
    for bad in ([([1.0], 1.0), ([1.0, 2.0], 2.0)], [([None], 1.0)], [([float("nan")], 1.0)], []):
        with pytest.raises(ValueError):
            wide_regression.fit_pls(spark.createDataFrame(bad, "x array<double>, y double"), "x", "y")
