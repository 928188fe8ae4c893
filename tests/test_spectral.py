"""The plans of each spectral step agree, and the steps have their textbook properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabatch.functions import stencils
from spectrabatch.functions.stencils import SpectralSteps
from spectrabatch.operators import scoring, spectral, spectral_long

POINTS = 40
AXIS = [300.0 + 40.0 * i for i in range(POINTS)]  # 350..1750 keeps the points 2..36


def table(spark, matrix):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(matrix)], "id long, s array<double>")


def rows(df):
    return np.array([r["s"] for r in df.orderBy("id").collect()])


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(1).normal(5.0, 2.0, (23, POINTS))


def long(df, axis):
    return spectral.to_long(df, ["id"], "s", axis, "v")


def grid(df, points):
    return np.array([r["v"] for r in df.orderBy("id", "wl").collect()]).reshape(-1, points)


def test_array_arrow_and_long_plan_agree(spark, noise):
    steps = SpectralSteps(window=7, order=3, segment=5, gap=3)
    df = table(spark, noise)
    arrow, axis = spectral.preprocess(df, "s", AXIS, steps, plan="arrow")
    array, _ = spectral.preprocess(df, "s", AXIS, steps, plan="array")
    assert axis == AXIS[2:37]
    np.testing.assert_allclose(rows(arrow), rows(array), atol=1e-12)

    data = spectral_long.range_cut(long(df, AXIS), "wl", steps.low, steps.high)
    data = spectral_long.linear_baseline(data, "id", "wl", "v")
    for taps in steps.tap_sequence():
        data = spectral_long.stencil(data, "id", "wl", "v", taps)
    np.testing.assert_allclose(grid(data, len(axis)), rows(arrow), atol=1e-12)


def test_single_steps_have_two_equal_plans(spark, noise):
    df = table(spark, noise)
    inside = [rows(step(df, "s", POINTS, plan="array")) for step in (spectral.norris_williams, spectral.savgol_smooth)]
    arrow = spectral.norris_williams(df, "s", POINTS)
    assert "MapInArrow" in arrow._jdf.queryExecution().executedPlan().toString()
    np.testing.assert_allclose(rows(arrow), inside[0], atol=1e-12)
    np.testing.assert_allclose(rows(spectral.savgol_smooth(df, "s", POINTS)), inside[1], atol=1e-12)


@pytest.mark.parametrize("plan", ["array", "arrow"])
def test_ragged_spectra_are_refused_and_gaps_stay_gaps(spark, plan):
    """Values never cross from one sample to the next."""
    ragged = spark.createDataFrame([(1, [1.0] * 5), (2, [2.0, 5.0, 5.0])], "id long, s array<double>").coalesce(1)
    with pytest.raises(Exception, match="points, expected 4"):
        spectral.savgol_smooth(ragged, "s", 4, 3, 1, plan=plan).collect()
    with pytest.raises(Exception, match="expected 4"):
        spectral.preprocess(ragged, "s", [1.0, 2.0, 3.0, 4.0], spectral.SpectralSteps(1, 4, 3, 1, 1, 1), plan=plan)[0].collect()
    gaps = spark.createDataFrame([(1, [1.0, None, 1.0, 1.0, 1.0]), (2, None), (3, [2.0] * 5)], "id long, s array<double>")
    got = {r["id"]: r["s"] for r in spectral.savgol_smooth(gaps, "s", 5, 3, 1, plan=plan).collect()}
    assert [np.isnan(v) for v in got[1]] == [True, True, True, False, False] and got[2] is None
    np.testing.assert_allclose(got[3], [2.0] * 5)


def test_arrow_plan_keeps_null_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, None, "b"), (3, [3.0, 4.0], "c")], "id long, s array<double>, t string")
    got = {r["id"]: (r["s"], r["t"]) for r in spectral.map_spectra(df, "s", 2, lambda b: b * 2).collect()}
    assert got == {1: ([2.0, 4.0], "a"), 2: (None, "b"), 3: ([6.0, 8.0], "c")}


def test_scaling_plans_agree_and_standardise(spark, noise):
    noise = noise.copy()
    noise[:, 3] = 4.0  # a constant point keeps divisor 1
    df = table(spark, noise)
    scaled = rows(spectral.standard_scale(df, "s"))
    np.testing.assert_allclose(scaled.mean(axis=0), 0, atol=1e-12)
    np.testing.assert_allclose(np.delete(scaled.std(axis=0), 3), 1, atol=1e-12)
    assert (scaled[:, 3] == 0).all()
    np.testing.assert_allclose(grid(spectral_long.standard_scale(long(df, AXIS), "wl", "v"), POINTS), scaled, atol=1e-12)


def test_scaler_is_fitted_on_training_rows_only(spark, noise):
    df = table(spark, noise)
    scaled = rows(spectral.standard_scale(df, "s", fitted_on=df.where("id < 10")))
    np.testing.assert_allclose(scaled[:10].mean(axis=0), 0, atol=1e-12)
    assert abs(scaled.mean()) > 1e-6


def test_blocks_are_scaled_apart(spark, noise):
    df = table(spark, noise).select("id", F.slice("s", 1, 4).alias("p"), F.slice("s", 5, POINTS).alias("q"))
    joined = rows(spectral.scale_blocks(df, ["p", "q"], "s"))
    np.testing.assert_allclose(joined, (noise - noise.mean(0)) / noise.std(0), atol=1e-12)


def test_line_vanishes_and_polynomials_survive(spark):
    x = np.arange(POINTS)
    lines = rows(spectral.linear_baseline(table(spark, [3 + 0.5 * x, 7 - x]), "s", POINTS))
    np.testing.assert_allclose(lines, 0, atol=1e-12)
    cubic = 1 + x - 0.1 * x**2 + 0.01 * x**3
    smooth = rows(spectral.savgol_smooth(table(spark, [cubic]), "s", POINTS, window=7, order=3))
    np.testing.assert_allclose(smooth[0][3:-3], cubic[3:-3], rtol=1e-10)
    slope = rows(spectral.norris_williams(table(spark, [3 + 0.5 * x]), "s", POINTS, segment=5, gap=3))
    np.testing.assert_allclose(slope[0][5:-5], 0.5, rtol=1e-12)


def test_taps_are_checked():
    assert stencils.savgol_taps(5, 2)[0] == pytest.approx(17 / 35)
    for bad in (lambda: stencils.savgol_taps(4, 2), lambda: stencils.savgol_taps(5, 5), lambda: stencils.segment_taps(2)):
        with pytest.raises(ValueError):
            bad()


def test_folded_model_scores_raw_spectra_like_the_chain(spark, noise):
    steps = SpectralSteps()
    df = table(spark, noise)
    processed, axis = spectral.preprocess(df, "s", AXIS, steps)
    scaler = spectral.fit_scaler(processed, "s")
    model = scoring.LinearModel("m", tuple(np.random.default_rng(2).normal(size=len(axis))), 1.5)
    chain = scoring.linear_score(scaler.transform(processed, "s"), "s", model)
    folded = scoring.fold_preprocessing(model, AXIS, steps, scaler.means, scaler.divisors)
    direct = scoring.linear_score(df, "s", folded)
    got = [[r["prediction"] for r in d.orderBy("id").collect()] for d in (chain, direct)]
    np.testing.assert_allclose(got[0], got[1], rtol=1e-9)


def test_scoring_plan_has_no_shuffle_and_no_python(spark, noise):
    model = scoring.LinearModel("m", (1.0,) * POINTS)
    plan = scoring.batch_scoring(table(spark, noise), "id", "s", model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_wide_table_round_trip(spark):
    df = spark.createDataFrame([(1, 3.0, 2.0, 1.5)], "id long, `2400` double, `300` double, `200.5` double")
    packed, axis = spectral.pack_spectrum(df, ["2400", "300", "200.5"])
    assert axis == [200.5, 300.0, 2400.0] and packed.first()["spectrum"] == [1.5, 2.0, 3.0]
    long_rows = spectral.wide_to_long(df, ["id"], ["2400", "300"]).orderBy("wl").collect()
    assert [(r["wl"], r["intensity"]) for r in long_rows] == [(300.0, 2.0), (2400.0, 3.0)]
