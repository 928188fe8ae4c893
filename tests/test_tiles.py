"""Tiles against NumPy's transpose."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabatch.operators import tiles


@pytest.mark.parametrize("samples,points,rows,columns", [(23, 17, 5, 4), (10, 6, 5, 6), (1, 9, 4, 2), (7, 1, 3, 3)])
def test_turned_equals_the_transpose(spark, samples, points, rows, columns):
    matrix = np.random.default_rng(samples).normal(size=(samples, points))
    axis = [100.0 + i for i in range(points)]
    data = [(3 * i, [float(v) for v in matrix[i]]) for i in np.random.default_rng(1).permutation(samples).tolist()]
    df = spark.createDataFrame(data, "id long, s array<double>").repartition(3)
    layout = tiles.tiled(df, "id", "s", axis, rows, columns)
    assert layout.count() == -(-samples // rows) * -(-points // columns)
    turned = tiles.turned(layout)
    got = {r["wl"]: r["values"] for r in tiles.joined(turned, "wl").collect()}
    assert sorted(got) == axis
    np.testing.assert_array_equal(np.array([got[w] for w in axis]), matrix.T)
    back = {r["id"]: r["values"] for r in tiles.joined(tiles.turned(turned), "id").collect()}
    np.testing.assert_array_equal(np.array([back[3 * i] for i in range(samples)]), matrix)
    labels = tiles.pieces(turned, "wl").where(F.col("wl") == axis[0]).orderBy("block").collect()
    assert [i for r in labels for i in r["labels"]] == [3 * i for i in range(samples)]


def test_200_000_samples_there_and_back(spark):
    """Row by row equal; no plan column per sample."""
    values = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda p: F.when((F.col("id") + p) % 11 != 0, F.sin(F.col("id") * 7 + p)))
    df = spark.range(200_000).select("id", values.alias("s")).repartition(8)
    turned = tiles.turned(tiles.tiled(df, "id", "s", [float(p) for p in range(7)], 4096, 3))
    lengths = tiles.joined(turned, "wl").select("wl", F.size("values").alias("n")).collect()
    assert sorted((r["wl"], r["n"]) for r in lengths) == [(float(p), 200_000) for p in range(7)]
    back = tiles.joined(tiles.turned(turned), "id", "t").join(df, "id")
    assert back.agg(F.count_if(F.col("s").eqNullSafe(F.col("t")))).first()[0] == 200_000


def test_bad_input_is_named(spark, monkeypatch):
    copies = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, s array<double>")
    with pytest.raises(Exception, match="unique values of id"):
        tiles.tiled(copies, "id", "s", [1.0, 2.0]).collect()
    with pytest.raises(Exception, match="sample 1 has not 3 values"):
        tiles.tiled(copies.limit(1), "id", "s", [1.0, 2.0, 3.0]).collect()
    empty = tiles.turned(tiles.tiled(copies.limit(0), "id", "s", [1.0, 2.0]))
    assert empty.count() == 0 and tiles.joined(empty, "wl").count() == 0
    monkeypatch.setattr(tiles, "LONGEST", 1)
    with pytest.raises(ValueError, match="use pieces"):
        tiles.joined(tiles.tiled(copies.withColumn("id", F.monotonically_increasing_id()), "id", "s", [1.0, 2.0]), "id")
