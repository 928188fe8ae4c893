"""Repeatable samples, splits and folds.

Random draws take the rows that come first in the order of a hash of key and
seed: the same rows on every run, after a lost executor, and in another engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numeric
from ..functions.numeric import order_hash
from . import positions
from .statistics import value_range

TOP_ROWS = 10_000  # drawn keys up to here are broadcast
GROUP_LIMIT = 1_000  # up to here Spark limits every group before the shuffle
SALTS = 64


def split_flag(df: DataFrame, key: str, test_share: float, seed: int = 42) -> Column:
    """True for the test rows: exactly ``ceil(n * test_share)`` of them."""
    return positions.first_in_hash_order(df, key, seed, lambda n: math.ceil(n * test_share))


def train_test_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` = test or train; the sizes are exact and the parts disjoint."""
    return df.withColumn("split", F.when(split_flag(df, key, test_share, seed), "test").otherwise("train"))


def assign_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    return positions.with_fold(df, key, seed, folds)


def random_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` random rows (all, if there are fewer); copies of a key are drawn together or not at all."""
    return df.where(positions.first_in_hash_order(df, key, seed, lambda rows: min(n, rows)))


def first_per_group(df: DataFrame, group: str, order: Sequence[str], k: int, salt: Column | None = None) -> DataFrame:
    """The first ``k`` rows of every group; a hot group never reaches one task whole.

    For small ``k`` Spark limits each group before the shuffle by itself
    (WindowGroupLimit). For larger ``k`` salted parts are limited first, by a
    hash of the order columns unless ``salt`` names another spread.
    """
    if k > GROUP_LIMIT:
        salt = F.struct(*order) if salt is None else salt
        salted = W.partitionBy(group, "_salt").orderBy(*order)
        df = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
        df = df.withColumn("_rn", F.row_number().over(salted)).where(F.col("_rn") <= k).drop("_rn", "_salt")
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_rn") <= k).drop("_rn")


def split_and_folds(df: DataFrame, key: str, test_share: float = 0.2, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``split`` and, for the training rows, ``fold``."""
    return positions.with_split_and_fold(df, key, seed, lambda n: math.ceil(n * test_share), folds)


def with_strata(df: DataFrame, column: str, bins: int = 10, edges: tuple | None = None) -> DataFrame:
    """Adds ``bin``: half-open equal-width strata between the edges (by default the range), so the maximum gets ``bins + 1``."""
    return df.withColumn("bin", numeric.half_open_bin(F.col(column), *(edges or value_range(df, column)), bins))


def _draw(narrow: DataFrame, key: str, column: str, bins: int, k: int, seed: int, edges: tuple | None = None) -> DataFrame:
    strata = with_strata(narrow.select(key, column), column, bins, edges).where(F.col("bin") <= bins)
    strata = strata.select(key, "bin", order_hash(key, seed).alias("_h"))
    return first_per_group(strata, "bin", ["_h", key], k, F.col("_h")).select(key, "bin")


def _rows_of(df: DataFrame, chosen: DataFrame, key: str, most: int) -> DataFrame:
    """The whole rows of the chosen keys; ``most`` is what bounds their number."""
    return df.join(F.broadcast(chosen) if most <= TOP_ROWS else chosen, key)


def stratified_sample(df: DataFrame, key: str, column: str, bins: int = 10, k: int = 10, seed: int = 42) -> DataFrame:
    """``k`` random rows of every stratum, or all if it has fewer; adds ``bin``.

    The draw sorts only key, stratum and hash. The wide rows are then filtered
    by the at most ``bins * k`` drawn keys and are never sorted or shuffled.
    """
    return _rows_of(df, _draw(df, key, column, bins, k, seed), key, bins * k)


def _pick_systematic(
    narrow: DataFrame, key: str, column: str, bins: int, k: int, only: Sequence[int] | None, edges: tuple | None = None
) -> DataFrame:
    strata = with_strata(narrow.select(key, column), column, bins, edges).where(F.col("bin") <= bins)
    if only is not None:
        strata = strata.where(F.col("bin").isin(list(only)))
    step = F.greatest(F.floor(F.col("_n") / F.lit(k)), F.lit(1)).cast("long")
    return positions.every_nth_row(strata, "bin", key, step, k).select(key, "bin")


def systematic_sample(df: DataFrame, key: str, column: str, bins: int = 10, k: int = 10,
                      only: Sequence[int] | None = None) -> DataFrame:
    """Every ``n div k``-th row of a stratum in key order, ``k`` of them; all if it has fewer."""
    return _rows_of(df, _pick_systematic(df, key, column, bins, k, only), key, bins * k)


def top_up(picked: DataFrame, pool: DataFrame, key: str, size: int, most: int, seed: int = 42) -> DataFrame:
    """Keys of the picked rows, filled to ``size`` with random keys of their pool, or cut to it.

    ``most`` bounds the number of picked keys. Marking them in the pool makes
    the set one ordered head: picked rows by stratum first, then the others in
    hash order. Returns key, ``bin`` and ``origin``.
    """
    marks = picked.select(key, "bin")
    marked = pool.select(key).join(F.broadcast(marks) if most <= TOP_ROWS else marks, key, "left")
    ordered = marked.withColumn("_h", order_hash(key, seed)).orderBy(F.col("bin").isNull(), "bin", "_h", key)
    origin = F.when(F.col("bin").isNull(), "filled").otherwise("picked")
    return ordered.limit(size).drop("_h").withColumn("origin", origin)


def prefer_then_fill(df: DataFrame, key: str, preferred: Column, size: int, seed: int = 42) -> DataFrame:
    """The first preferred rows in key order; if too few, random others. Adds ``preferred``."""
    flagged = df.withColumn("preferred", F.coalesce(preferred, F.lit(False)))
    draw = F.when(~F.col("preferred"), order_hash(key, seed))
    return flagged.withColumn("_h", draw).orderBy(F.col("preferred").desc(), "_h", key).limit(size).drop("_h")


# Rules of the published test sets.
TEST_SHARE = 0.2
TEST_SET_SIZE = 100
STRATA = 10
PER_STRATUM = 10
REALISTIC_RANGE = (0.5, 25.0)
DEMO_RANGE = (0.1, 25.0)
OUTER_STRATA = (1, 2, 9, 10)


def stratified_test_set(df: DataFrame, key: str, target: str, low: float, high: float, seed: int = 42) -> DataFrame:
    """Test split, outlier filter (both ends kept), strata picks, top-up."""
    return stratified_test_set_and_range(df, key, target, low, high, seed)[0]


def stratified_test_set_and_range(
    df: DataFrame, key: str, target: str, low: float, high: float, seed: int = 42
) -> tuple[DataFrame, tuple]:
    """The set, and the range of the pool it was drawn from."""

    def pick(held_out: DataFrame, edges: tuple) -> DataFrame:
        return _draw(held_out, key, target, STRATA, PER_STRATUM, seed, edges)

    return _test_set(df, key, target, F.col(target).between(low, high), pick, seed)


def performance_test_set(df: DataFrame, key: str, target: str, seed: int = 42) -> DataFrame:
    """Test split without filter; outer strata systematically, inner ones at random, top-up."""

    def pick(held_out: DataFrame, edges: tuple) -> DataFrame:
        outer = _pick_systematic(held_out, key, target, STRATA, PER_STRATUM, OUTER_STRATA, edges)
        inner = _draw(held_out, key, target, STRATA, PER_STRATUM, seed, edges)
        return outer.unionByName(inner.where(~F.col("bin").isin(list(OUTER_STRATA))))

    return _test_set(df, key, target, F.lit(True), pick, seed)[0]


def _test_set(df: DataFrame, key: str, target: str, keep: Column, pick, seed: int) -> tuple[DataFrame, tuple]:
    """Key and target alone decide the set; the whole rows are read once, at the end.

    The held-out part of these two columns is passed over several times and
    therefore kept (on disk where memory is short). What comes to the driver
    are the at most 100 chosen keys.
    """
    narrow = df.select(key, target)
    held_out = narrow.where(split_flag(narrow, key, TEST_SHARE, seed)).where(keep).persist()
    try:
        edges = value_range(held_out, target)
        picked = pick(held_out, edges)
        chosen = top_up(picked, held_out, key, TEST_SET_SIZE, STRATA * PER_STRATUM, seed)
        rows = chosen.collect()
    finally:
        held_out.unpersist()
    return _rows_of(df, df.sparkSession.createDataFrame(rows, chosen.schema), key, TEST_SET_SIZE), edges
