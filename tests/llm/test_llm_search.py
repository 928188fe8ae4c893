"""Bit-sliced top-k against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabatch.llm import bit_sliced
from spectrabatch.session import ship_package

SCHEMA = "vec_id long, embedding array<float>, label int, q string, block string"


def brute(data, k):
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in good if i % 50 == 0}):
        mine = min(v for j, v in good if j == i)
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), j) for j, v in good if j != i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block_rows, chunk_queries, levels", [(16_384, 512, 40), (40, 2, 3), (7, 1, 1)])
def test_ties_negatives_gaps_and_ragged_vectors(spark, block_rows, chunk_queries, levels):
    ship_package(spark)
    rng = random.Random(levels)
    data = [(i, [rng.randrange(-levels, levels + 1) / 16 for _ in range(6)]) for i in range(230)]
    data += [(1000, None), (1001, []), (1002, [1.0, None]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6), (50, [9.0] * 6), (None, [1.0] * 6)]
    data += [(1050, [0.0] * 6), (1100, [3.5, -2.0]), (1101, [1.0] * 9), (7, data[7][1]), (-50, [-1.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in data], SCHEMA).repartition(3)
    found = bit_sliced.top_k(frame, "embedding", F.col("vec_id") % 50 == 0, 5, block_rows=block_rows, chunk_queries=chunk_queries)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == sorted(brute(data, 5))


def test_fewer_rows_than_asked(spark):
    ship_package(spark)
    frame = spark.createDataFrame([(0, [1.0], 1, "", ""), (1, [2.0], 1, "", "")], SCHEMA)
    found = bit_sliced.top_k(frame, "embedding", F.col("vec_id") % 50 == 0, 5).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 256 * 512)]
    assert bit_sliced.top_k(frame.limit(0), "embedding", F.col("vec_id") % 50 == 0, 5).count() == 0


def test_too_large_scores_are_refused():
    block = bit_sliced.Block(np.array([1, 2]), np.array([[0], [1 << 40]]))
    with pytest.raises(OverflowError):
        block.scores(np.array([1 << 30]))
