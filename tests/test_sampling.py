"""Exact sizes, disjoint parts, hot groups and copies."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabatch.operators import positions, quantiles, sampling
from spectrabatch.operators import statistics as stats


def keyed(spark, n, value="double(id)"):
    return spark.range(n).selectExpr("id", f"{value} AS v").repartition(5)


def hash_rank(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n,share", [(0, 0.2), (1, 0.2), (7, 0.4), (1000, 0.2), (1003, 0.25)])
def test_split_is_exact_and_in_hash_order(spark, n, share):
    parts = sampling.train_test_split(keyed(spark, n), "id", share)
    test = {r["id"] for r in parts.where("split = 'test'").collect()}
    assert test == set(hash_rank(range(n))[: math.ceil(n * share)])
    assert parts.count() == n


def test_split_refines_large_cells(spark, monkeypatch):
    monkeypatch.setattr(positions, "RANK_ROWS", 2)
    n = 20_000
    cut = positions.hash_cuts(keyed(spark, n), "id", 42, lambda size: [1, size // 2, size, 0])
    order = hash_rank(range(n))
    assert [c and c[1] for c in cut] == [order[0], order[n // 2 - 1], order[-1], None]


def test_copies_of_a_key_stay_on_one_side(spark, monkeypatch):
    monkeypatch.setattr(positions, "RANK_ROWS", 10)
    hot = spark.range(600).select(F.lit(7).cast("long").alias("id"))
    df = hot.union(spark.range(100, 1300).select("id"))
    parts = sampling.train_test_split(df, "id", 0.5)
    assert parts.where("id = 7").select("split").distinct().count() == 1
    sides = {r["split"]: r["n"] for r in parts.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(sides.values()) == 1800 and abs(sides["test"] - 900) <= 600


@pytest.mark.parametrize("n", [3, 10, 103])
def test_folds_are_contiguous_and_larger_first(spark, n):
    folded = {r["id"]: r["fold"] for r in sampling.assign_folds(keyed(spark, n), "id", 5).collect()}
    expected = [f + 1 for f, part in enumerate(np.array_split(np.arange(n), 5)) for _ in part]
    assert [folded[i] for i in hash_rank(range(n))] == expected


@pytest.mark.parametrize("n", [0, 1, 4, 103])
def test_split_and_folds_in_one_search(spark, n):
    df = keyed(spark, n)
    parts = sampling.train_test_split(df, "id", 0.2)
    two = positions.with_fold(parts, "id", 42, 5, among=F.col("split") == "train")
    one = sampling.split_and_folds(df, "id", 0.2, 5)
    take = lambda frame: sorted((r["id"], r["split"], r["fold"]) for r in frame.collect())
    assert take(one) == take(two)


def test_missing_keys_are_refused(spark):
    df = spark.range(90).selectExpr("IF(id % 3 = 0, NULL, id) AS id", "double(id) AS v")
    for build in (lambda: sampling.assign_folds(df, "id", 5), lambda: sampling.train_test_split(df, "id"), lambda: positions.with_position(df, "id")):
        with pytest.raises(ValueError, match="missing"):
            build()


def test_random_sample_both_plans(spark, monkeypatch):
    df = keyed(spark, 500)
    small = {r["id"] for r in sampling.random_sample(df, "id", 40).collect()}
    monkeypatch.setattr(sampling, "TOP_ROWS", 10)
    large = {r["id"] for r in sampling.random_sample(df, "id", 40).collect()}
    assert small == large == set(hash_rank(range(500))[:40])
    assert sampling.random_sample(df, "id", 1000).count() == 500


def test_random_sample_of_copies_does_not_depend_on_the_size(spark):
    df = spark.range(20_000).selectExpr("id div 4 AS id")
    counts = [sampling.random_sample(df, "id", n).count() for n in (9_999, 10_000, 10_001)]
    assert counts == [10_000, 10_000, 10_004]


def test_positions_are_complete(spark, monkeypatch):
    monkeypatch.setattr(positions, "CELL_ROWS", 20)
    df = spark.range(1000).selectExpr("id * id AS id").repartition(7)
    numbered = positions.with_position(df, "id").orderBy("id").collect()
    assert [r["position"] for r in numbered] == list(range(1, 1001))
    assert positions.with_position(df.limit(0), "id").count() == 0


def test_systematic_sample_of_a_hot_stratum(spark, monkeypatch):
    """A third and more of all rows in one stratum: positions equal a plain ranking."""
    monkeypatch.setattr(positions, "CELL_ROWS", 50)
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 0.5 ELSE double(id % 100) END AS v")
    got = sampling.systematic_sample(df, "id", "v", 10, 10)
    rows = [(r["id"], r["v"]) for r in df.collect()]
    low, high = min(v for _, v in rows), max(v for _, v in rows)
    width, expected = (high - low) / 10, set()
    for b in range(10):
        upper = high if b == 9 else low + (b + 1) * width
        members = sorted(i for i, v in rows if low + b * width <= v < upper)
        step = max(len(members) // 10, 1)
        expected |= set(members[::step][:10])
    assert {r["id"] for r in got.collect()} == expected


def test_stratified_sample_takes_all_of_small_strata(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(30)] + [(100, 9.5), (101, 10.0)], "id long, v double")
    counts = {r["bin"]: r["count"] for r in sampling.stratified_sample(df, "id", "v", 10, 10).groupBy("bin").count().collect()}
    assert counts == {1: 10, 10: 1}  # the maximum belongs to no stratum


def test_first_per_group_salted_plan(spark):
    df = spark.range(20_000).selectExpr("id", "IF(id % 3 = 0, 0, 1) AS g")
    got = sampling.first_per_group(df, "g", ["id"], 1500, F.col("id"))
    expected = {i for g in (0, 1) for i in [i for i in range(20_000) if (0 if i % 3 == 0 else 1) == g][:1500]}
    assert {r["id"] for r in got.collect()} == expected


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS g", "md5(string(id)) AS h")
    plan = sampling.first_per_group(df, "g", ["h"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_test_sets_have_exactly_100_rows(spark):
    df = spark.range(5000).selectExpr("id", "abs(sin(id)) * 30 AS v")
    for chosen in (
        sampling.stratified_test_set(df, "id", "v", *sampling.REALISTIC_RANGE),
        sampling.performance_test_set(df, "id", "v"),
    ):
        assert chosen.count() == 100 and chosen.select("id").distinct().count() == 100
    few = df.where("id < 200")
    assert sampling.performance_test_set(few, "id", "v").count() == 40  # no more were held out


def test_prefer_then_fill(spark):
    df = keyed(spark, 100)
    got = sampling.prefer_then_fill(df, "id", F.col("v") > 95, 10).collect()
    assert sorted(r["id"] for r in got if r["preferred"]) == [96, 97, 98, 99]
    assert {r["id"] for r in got if not r["preferred"]} == set(hash_rank(range(96))[:6])


@pytest.mark.parametrize("small", [10, 100_000])
def test_exact_quantiles(spark, monkeypatch, small):
    """Bracketed and whole-column selection give NumPy's numbers, with heavy ties."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    df = spark.range(30_000).selectExpr("double(id * 7919 % 30011) AS a", "double(id % 4) AS b", "IF(id % 5 = 0, NULL, exp(id % 97 / 9.0)) AS c")
    pdf = df.toPandas()
    got = {(r["variable"], r["share"]): r["quantile"] for r in quantiles.exact_quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert len(got) == 15
    for (name, share), value in got.items():
        assert value == pytest.approx(pdf[name].quantile(share), rel=1e-12)


@pytest.mark.parametrize("rank_rows", [1, 10, 200])
def test_quantiles_narrow_large_brackets(spark, monkeypatch, rank_rows):
    """Rounds of ever narrower brackets end at the same numbers, also where one value fills a bracket."""
    monkeypatch.setattr(quantiles, "SMALL", 10)
    monkeypatch.setattr(quantiles, "RANK_ROWS", rank_rows)
    df = spark.range(60_000).selectExpr("double(id * 7919 % 60013) AS a", "double(id % 3) AS b", "IF(id % 5 = 0, NULL, exp(id % 9973 / 900.0)) AS c")
    pdf = df.toPandas()
    for r in quantiles.exact_quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 0.999, 1.0]).collect():
        assert r["quantile"] == pytest.approx(pdf[r["variable"]].quantile(r["share"]), rel=1e-12)


def test_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert quantiles.exact_quantiles(df, ["a"], [0.5]).count() == 0
    assert stats.describe(df, ["a"]).first()["p50"] is None


def test_histogram_keeps_maximum_and_skips_null(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,), (10.0,)], "v double")
    assert {r["bin"]: r["n"] for r in stats.histogram(df, "v", 10).collect()} == {1: 1, 2: 1, 10: 1}
    empty = stats.bin_population(df, "v", 0.0, 10.0, 5)
    assert [r["n"] for r in empty.orderBy("bin").collect()] == [2, 0, 0, 0, 0]
