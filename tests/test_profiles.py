"""Profiles from sketches against NumPy, merged parts against the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabatch.operators import profiles
from spectrabatch.operators import statistics as stats

SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    n = 30_000
    table = {"a": rng.normal(size=n), "b": rng.integers(0, 7, n).astype(float), "c": np.exp(3 * rng.normal(size=n)), "d": np.where(rng.random(n) < 0.34, 5.0, rng.random(n))}
    rows = [(i, *(float(table[c][i]) if (i + k) % 11 else None for k, c in enumerate("abcd"))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double").repartition(5).persist()


def values(frame, column):
    return np.array([r[0] for r in frame.where(F.col(column).isNotNull()).select(column).collect()])


def facts_of(frame, columns):
    rows = profiles.profile(frame, columns)
    return rows.select("*", profiles.bracket_column(F.col("sketch"), SHARES, F.col("n") - F.col("nan")).alias("ends")).collect()


@pytest.mark.parametrize("rank_rows", [1_000_000, 50, 1])
def test_quantiles_are_exact(frame, monkeypatch, rank_rows):
    monkeypatch.setattr(profiles, "RANK_ROWS", rank_rows)
    found = profiles.quantiles(frame, facts_of(frame, "abcd"), SHARES)
    for column in "abcd":
        np.testing.assert_allclose([found[column, s] for s in SHARES], np.quantile(values(frame, column), SHARES), rtol=1e-12)


def test_a_bracket_that_misses_is_seen(frame):
    facts = [{"variable": "a", "n": f["n"], "nan": 0, "ends": [9e9] * (2 * len(SHARES))} for f in facts_of(frame, "a")]
    found = profiles.quantiles(frame, facts, SHARES)
    np.testing.assert_allclose([found["a", s] for s in SHARES], np.quantile(values(frame, "a"), SHARES), rtol=1e-12)


def test_merged_parts_are_the_whole(spark, frame, tmp_path):
    store = profiles.ProfileStore(spark, str(tmp_path / "store"))
    assert store.whole().count() == 0 and store.value_range("a") == (None, None)
    for part in (0, 1, 2, 1):  # a part that comes again replaces itself
        store.add(frame.where(F.col("id") % 3 == part), "abcd", f"p{part}")
    store.add(frame.where("false"), "abcd", "empty")
    whole = {r["variable"]: r for r in profiles.profile(frame, "abcd").collect()}
    for r in store.whole().collect():
        want = whole[r["variable"]]
        assert (r["n"], r["nan"], r["low"], r["high"]) == (want["n"], 0, want["low"], want["high"])
        np.testing.assert_allclose([r["mean"], r["m2"]], [want["mean"], want["m2"]], rtol=1e-9)
    got = {r["variable"]: r for r in store.describe(frame).collect()}
    direct = {r["variable"]: r for r in stats.describe(frame, list("abcd")).collect()}
    for column in "abcd":
        assert got[column]["count"] == direct[column]["count"]
        np.testing.assert_allclose([got[column][k] for k in ("mean", "std", "min", "p25", "p50", "p75", "max")], [direct[column][k] for k in ("mean", "std", "min", "p25", "p50", "p75", "max")], rtol=1e-9)
    assert store.value_range("c") == (whole["c"]["low"], whole["c"]["high"])


def test_profiles_by_key_merge_by_key(frame):
    keyed = frame.withColumn("batch", F.col("id") % 4).withColumn("day", F.col("id") % 3)
    merged = profiles.merge(profiles.profile(keyed, ["a"], ["batch", "day"]), ["batch"])
    want = {r["batch"]: r for r in keyed.groupBy("batch").agg(F.count("a").alias("n"), F.avg("a").alias("mean")).collect()}
    for r in merged.collect():
        assert r["n"] == want[r["batch"]]["n"] and r["mean"] == pytest.approx(want[r["batch"]]["mean"], rel=1e-9)


def test_empty_columns_and_nan(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (2.0, None, 1.0), (4.0, None, 3.0)], "a double, b double, c double")
    rows = {r["variable"]: r for r in stats.describe(df, ["a", "b", "c"]).collect()}
    assert (rows["a"]["p50"], rows["a"]["count"]) == (2.0, 3)
    assert (rows["b"]["p50"], rows["b"]["min"], rows["b"]["count"]) == (None, None, 0)
    assert rows["c"]["p25"] == 2.0 and rows["c"]["p50"] == 3.0
    assert stats.target_overview(df.where("false"), "a").first()["median"] is None
