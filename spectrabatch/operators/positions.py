"""Exact positions in a global order without a single-partition window.

The order is cut into cells that every row can name on its own: the leading
digits of a hash, or those of a numeric key (``rank_index``). Counting rows per
cell gives the position at which each cell starts; only rows of cells that hold a
wanted position are ever ranked. Keys have to be unique; copies of one key
stay together, so a split never puts copies on both sides.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import order_hash
from . import rank_index
from .rank_index import RankIndex

DIGITS = 3  # hexadecimal digits per round: 4,096 cells
MAX_DIGITS = 28  # beyond these, rows with equal digits are copies of one key
RANK_ROWS = 1_000_000  # rows of one cell that a single task may rank
CELL_ROWS = 1_000_000
MIN_CELLS = 16


def _running(cells: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows before each cell and rows in all cells, per group; at most one row per cell."""
    by_group = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    up_to = by_group.orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    return cells.select(
        *groups,
        "_cell",
        (F.sum("_size").over(up_to) - F.col("_size")).alias("_before"),
        "_size",
        F.sum("_size").over(by_group).alias("_n"),
    )


def hash_cuts(df: DataFrame, key: str, seed: int, places: Callable[[int], Sequence[int]]) -> list[tuple | None]:
    """The (hash, key) at each 1-based position of the hash order, ``None`` for position 0.

    ``places`` turns the number of rows into positions. Each round counts rows
    per next ``DIGITS`` digits, within the cells that hold a position only,
    until those cells are small. The driver sees at most 4,096 counts per cut
    and round; as literals the cuts make every later pass a plain filter.
    """
    ranked = df.select(order_hash(key, seed).alias("_h"), F.col(key).alias("_key"))
    digits, cells, left = 0, [], []
    while True:
        held = ranked.where(F.substring("_h", 1, digits).isin(cells)) if digits else ranked
        digits += DIGITS
        missing = F.count_if(F.col("_key").isNull()).alias("missing")
        counts = held.groupBy(F.substring("_h", 1, digits).alias("c")).agg(F.count(F.lit(1)).alias("n"), missing).collect()
        if any(row["missing"] for row in counts):
            raise ValueError(f"{key} is missing in some rows, which have no place of their own")
        sizes = sorted((row["c"], row["n"]) for row in counts)
        if not left:
            left = [int(p) for p in places(sum(n for _, n in sizes))]
            cells = [""] * len(left)
        for cut, (prefix, place) in enumerate(zip(cells, left)):
            for cell, n in sizes:
                if cell.startswith(prefix) and place > 0:
                    if place <= n:
                        cells[cut], left[cut] = cell, place
                        break
                    place -= n
        hit = {cell for cell, place in zip(cells, left) if place > 0}
        if max((n for cell, n in sizes if cell in hit), default=0) <= RANK_ROWS or digits > MAX_DIGITS:
            break
    if not hit:
        return [None] * len(left)
    # Copies of a key collapse before they are ranked.
    cell = F.substring("_h", 1, digits).alias("_cell")
    keys = ranked.where(cell.isin(list(hit))).groupBy(cell, "_h", "_key").agg(F.count(F.lit(1)).alias("_size"))
    upto = F.sum("_size").over(W.partitionBy("_cell").orderBy("_h", "_key"))
    keys = keys.withColumn("_upto", upto)
    found: list[tuple | None] = [None] * len(left)
    at = reduce(
        operator.or_,
        [
            (F.col("_cell") == c) & (F.col("_upto") >= p) & (F.col("_upto") - F.col("_size") < p)
            for c, p in zip(cells, left)
            if p > 0
        ],
    )
    for row in keys.where(at).collect():
        for cut, (c, p) in enumerate(zip(cells, left)):
            if c == row["_cell"] and row["_upto"] - row["_size"] < p <= row["_upto"]:
                found[cut] = (row["_h"], row["_key"])
    return found


def first_in_hash_order(df: DataFrame, key: str, seed: int, size: Callable[[int], int]) -> Column:
    """True for exactly the first ``size(n)`` of ``n`` rows in hash order.

    Rows are compared with one cut value, so the data itself is not shuffled.
    """
    cut = hash_cuts(df, key, seed, lambda n: [size(n)])[0]
    if cut is None:
        return F.lit(False)
    # One struct comparison hashes each row once.
    here = F.struct(order_hash(key, seed).alias("h"), F.col(key).alias("k"))
    return F.coalesce(here <= F.struct(F.lit(cut[0]).alias("h"), F.lit(cut[1]).alias("k")), F.lit(False))


def with_fold(
    df: DataFrame, key: str, seed: int, folds: int, name: str = "fold", among: Column | None = None
) -> DataFrame:
    """Adds fold 1..folds; folds are contiguous in hash order and larger ones come first.

    With ``among`` only those rows are divided, the others get NULL.
    """

    cuts = hash_cuts(df if among is None else df.where(among), key, seed, lambda n: _fold_ends(n, folds))
    fold = _fold_of(key, cuts)
    if among is not None:
        fold = F.when(among, fold)
    # The hash is a column of its own, since it is compared with every cut.
    return df.withColumn("_h", order_hash(key, seed)).withColumn(name, fold.cast("long")).drop("_h")


def with_split_and_fold(
    df: DataFrame, key: str, seed: int, test: Callable[[int], int], folds: int, names: tuple[str, str] = ("split", "fold")
) -> DataFrame:
    """Adds the split (the first ``test(n)`` rows in hash order are the test rows) and the fold of the training rows.

    Both cut the same order, so one search finds all the cuts.
    """

    def places(n: int) -> list[int]:
        held_out = test(n)
        return [held_out, *(held_out + end if end else 0 for end in _fold_ends(n - held_out, folds))]

    first, *cuts = hash_cuts(df, key, seed, places)
    is_test = F.lit(False) if first is None else _up_to(key, first)
    fold = F.when(is_test, F.lit(None)).otherwise(_fold_of(key, cuts))
    hashed = df.withColumn("_h", order_hash(key, seed))
    return hashed.withColumns({names[0]: F.when(is_test, "test").otherwise("train"), names[1]: fold.cast("long")}).drop("_h")


def _fold_ends(n: int, folds: int) -> list[int]:
    small, extra = divmod(n, folds)
    return [small * f + min(f, extra) for f in range(1, folds)]


def _up_to(key: str, cut: tuple) -> Column:
    """Whether a row with its hash in ``_h`` does not come after the cut."""
    h, k = F.lit(cut[0]), F.lit(cut[1])
    return (F.col("_h") < h) | ((F.col("_h") == h) & (F.col(key) <= k))


def _fold_of(key: str, cuts: Sequence[tuple | None]) -> Column:
    fold = F.lit(len(cuts) + 1)
    for f, cut in reversed(list(enumerate(cuts, start=1))):
        if cut is not None:
            fold = F.when(_up_to(key, cut), f).otherwise(fold)
    return fold


def with_position(df: DataFrame, key: str, name: str = "position", index: RankIndex | None = None) -> DataFrame:
    """1-based position of every row in the order of a unique key.

    ``index`` may come from another table with at least these keys, which spares
    the passes over a costly ``df``: only the rows per cell are counted again.
    """
    if index is None:
        return _index(df, key).with_position(df, name)
    celled = index.with_start(df, "_cell")
    starts = _running(celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_size")), []).select("_cell", "_before")
    rank = F.row_number().over(W.partitionBy("_cell").orderBy(key))
    joined = celled.join(starts, "_cell")
    return joined.withColumn(name, F.col("_before") + rank).drop("_cell", "_before")


def _index(df: DataFrame, key: str) -> RankIndex:
    return rank_index.build(df.select(key), key, cell_rows=CELL_ROWS, min_cells=MIN_CELLS)


def every_nth_row(df: DataFrame, group: str, key: str, step: Column, count: int) -> DataFrame:
    """Rows 1, 1 + step, 1 + 2 step, ... of their group in key order, at most ``count`` of them.

    ``step`` may use ``_n``, the size of the group. A group of any size is split
    into cells, so no task ranks it whole; which cells hold a wanted row follows
    from the rows before them. Adds ``_pos``.
    """
    celled = _index(df, key).with_start(df, "_cell")
    sizes = _running(celled.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_size")), [group]).withColumn("_step", step)
    first = F.ceil(F.col("_before") / F.col("_step"))
    hit = sizes.where((first * F.col("_step") < F.col("_before") + F.col("_size")) & (first < count))
    rank = F.row_number().over(W.partitionBy(group, "_cell").orderBy(key))
    ranked = celled.join(hit.select(group, "_cell", "_before", "_step"), [group, "_cell"]).withColumn("_pos", F.col("_before") + rank)
    wanted = ((F.col("_pos") - 1) % F.col("_step") == 0) & (F.col("_pos") <= F.col("_step") * (count - 1) + 1)
    return ranked.where(wanted).drop("_cell", "_before", "_step")
