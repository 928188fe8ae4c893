"""Cells, positions and slices of the rank index against plain sorting."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabatch.operators import rank_index, schema


def keys_of(kind):
    rng = np.random.default_rng(3)
    if kind == "crowded":  # nearly all keys in a few places of a wide range
        near = np.concatenate([np.arange(700), 10**12 + 7 * np.arange(300), -(10**15) + np.arange(5)])
        return [int(k) for k in near] + [2**62]
    if kind == "whole range":
        return [-(2**63), 2**63 - 1, 0, -1, 5] + [int(k) for k in rng.integers(-(2**62), 2**62, 400)]
    if kind == "double":
        return [float(k) for k in rng.normal(0, 1e-3, 500)] + [0.0, 1e300, -1e300, 5e-324, math.inf, -math.inf, math.nan]
    return [dt.date(1950, 1, 1) + dt.timedelta(days=int(d)) for d in rng.permutation(900)]


TYPES = {"crowded": "long", "whole range": "long", "double": "double", "date": "date"}


@pytest.mark.parametrize("kind", list(TYPES))
def test_positions_and_cell_bounds(spark, kind):
    keys = keys_of(kind)
    df = spark.createDataFrame([(k,) for k in keys], f"k {TYPES[kind]}").repartition(4)
    index = rank_index.build(df, "k", cell_rows=20)
    got = [r["k"] for r in index.with_position(df, "p").orderBy("p").collect()]
    expected = sorted(keys, key=lambda k: (isinstance(k, float) and math.isnan(k), 0 if isinstance(k, float) and math.isnan(k) else k))
    assert len(got) == len(keys) and str(got) == str(expected)
    cells = index.cells.orderBy("start").collect()
    assert sum(c["n"] for c in cells) == len(keys) and max(c["n"] for c in cells) <= 20
    assert all(a["high"] < b["low"] and a["start"] + a["n"] == b["start"] for a, b in zip(cells, cells[1:]))


def test_a_slice_reads_two_cells(spark, tmp_path):
    """The slice at position 10^6: two cells, the range reaches the scan, the index is read back from its folder."""
    spark.range(2_000_000).selectExpr("id * 3 AS k").repartitionByRange(8, "k").sortWithinPartitions("k").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    rank_index.build(df, "k", f"{tmp_path}/index", cell_rows=10_000)
    index = rank_index.RankIndex.open(spark, f"{tmp_path}/index")
    touched = index.touched(1_000_000, 1_000_100).collect()
    assert len(touched) <= 2 and sum(c["n"] for c in touched) <= 20_000
    part = index.slice(df, 1_000_000, 1_000_100, "position")
    assert sorted(tuple(r) for r in part.collect()) == [(3 * i, i + 1) for i in range(1_000_000, 1_000_100)]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k," in plan and "LessThanOrEqual(k," in plan
    ends = index._between(min(c["low"] for c in touched), max(c["high"] for c in touched))
    assert df.where(ends).count() == sum(c["n"] for c in touched)


def test_copies_of_a_hot_key_and_slices_beyond_the_end(spark):
    df = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id + 10 END AS k")
    index = rank_index.build(df, "k", cell_rows=30)
    assert sorted(r["p"] for r in index.with_position(df, "p").collect()) == list(range(1, 901))
    assert index.slice(df, 0, 300).distinct().count() == 1
    assert index.slice(df, 890, 2000).count() == 10 and index.slice(df, 900, 901).count() == 0
    assert index.slice(df, 5, 5).count() == 0


def test_empty_missing_and_foreign_keys(spark):
    empty = rank_index.build(spark.range(0), "id")
    assert empty.cells.count() == 0 and empty.slice(spark.range(0), 0, 5).count() == 0
    with pytest.raises(ValueError, match="missing"):
        rank_index.build(spark.sql("SELECT CAST(NULL AS LONG) AS k"), "k")
    with pytest.raises(TypeError, match="no position"):
        rank_index.build(spark.sql("SELECT 'a' AS k"), "k")
    with pytest.raises(Exception, match="not in the index"):
        rank_index.build(spark.range(0, 100, 50), "id", cell_rows=1).with_start(spark.range(100)).collect()


def test_deep_row_slice_keeps_other_columns(spark):
    df = spark.range(50_000).select((F.col("id") * 2).alias("a.b"), "id").repartition(6)
    part = schema.row_slice(df, "id", 20_000, 20_010)
    assert part.columns == ["a.b", "id"] and sorted(r["id"] for r in part.collect()) == list(range(20_000, 20_010))
