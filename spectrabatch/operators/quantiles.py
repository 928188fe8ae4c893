"""Exact quantiles without bringing a column together.

The built-in exact percentile keeps every distinct value of a group in one
buffer. Here a bounded sketch only brackets each quantile; the exact value is
then selected among the few rows inside its bracket.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY  # the sketch errs by at most 1 / ACCURACY of the rows
SMALL = 20_000  # below this the bracket is the whole column
RANK_ROWS = 1_000_000  # rows of one bracket that a single task may rank


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Rows ``(variable, share, quantile)`` with linear interpolation; NULL is skipped.

    Narrow passes: bracket, count below and inside, select inside. The first two
    give one row each, which becomes literals of the next. A bracket that still
    holds more than ``RANK_ROWS`` rows is bracketed again within itself, so the
    rows that meet in one task do not grow with the table.
    """
    pairs = [(i, q) for i in range(len(columns)) for q in range(len(shares))]
    brackets = df.agg(*[_bracket(c, shares).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    low = {(i, q): brackets[f"b{i}"]["low"][q] for i, q in pairs}
    high = {(i, q): brackets[f"b{i}"]["high"][q] for i, q in pairs}
    pairs = [p for p in pairs if low[p] is not None]
    if not pairs:
        return df.sparkSession.createDataFrame([], "variable string, share double, quantile double")
    places = {p: float(shares[p[1]] * (brackets[f"b{p[0]}"]["n"] - 1)) for p in pairs}

    def name(pair: tuple[int, int]) -> str:
        return f"n_{pair[0]}_{pair[1]}"

    while True:
        counts = [
            count.alias(f"{which}{name(p)}")
            for p in pairs
            for which, count in (
                ("b", F.count_if(F.col(columns[p[0]]) < low[p])),
                ("i", F.count_if(F.col(columns[p[0]]).between(low[p], high[p]))),
            )
        ]
        found = df.agg(F.lit(0).alias("n"), *counts).first()
        below = {p: found[f"b{name(p)}"] for p in pairs}
        wide = [p for p in pairs if found[f"i{name(p)}"] > RANK_ROWS and low[p] < high[p]]
        if not wide:
            break
        tighter = df.agg(*[_narrower(columns[p[0]], low[p], high[p], places[p] - below[p], found[f"i{name(p)}"]).alias(name(p)) for p in wide]).first()
        ends = {p: tuple(tighter[name(p)]) for p in wide}
        if all(ends[p] == (low[p], high[p]) for p in wide):
            break  # one value fills the bracket, or nearly so: few different values are left to rank
        for p in wide:
            low[p], high[p] = ends[p]

    inside = [(F.col(columns[i]) >= low[i, q]) & (F.col(columns[i]) <= high[i, q]) for i, q in pairs]
    candidates = [F.when(test, F.col(columns[i]).cast("double")).alias(str(k)) for k, (test, (i, _)) in enumerate(zip(inside, pairs))]
    touched = df.where(reduce(operator.or_, inside)).select(*candidates)
    values = touched.unpivot([], [str(k) for k in range(len(pairs))], "k", "v").where(F.col("v").isNotNull())
    sizes = values.groupBy(F.col("k").cast("int").alias("k"), "v").agg(F.count(F.lit(1)).alias("size"))

    def known(numbers: list) -> Column:
        return F.get(F.lit(numbers), F.col("k"))

    start = known([int(below[p]) for p in pairs])
    place = known([places[p] for p in pairs])
    upto = start + F.sum("size").over(W.partitionBy("k").orderBy("v"))
    located = sizes.withColumns({"upto": upto, "place": place})

    def at(position: Column) -> Column:
        covers = (position + 1 > F.col("upto") - F.col("size")) & (position + 1 <= F.col("upto"))
        return F.max(F.when(covers, F.col("v")))

    picked = located.groupBy("k").agg(
        at(F.floor("place")).alias("left"), at(F.ceil("place")).alias("right"), F.max("place").alias("place")
    )
    value = F.col("left") + (F.col("right") - F.col("left")) * (F.col("place") - F.floor("place"))
    checked = F.coalesce(value, F.raise_error(F.lit("quantile lies outside its bracket")).cast("double"))
    return picked.select(
        known([columns[i] for i, _ in pairs]).alias("variable"),
        known([float(shares[q]) for _, q in pairs]).alias("share"),
        checked.alias("quantile"),
    )


def _bracket(column: str, shares: Sequence[float]) -> Column:
    value, parts = F.col(column).cast("double"), len(shares)
    n, low, high = F.count(column), F.min(value), F.max(value)
    around = [max(s - MARGIN, 0.0) for s in shares] + [min(s + MARGIN, 1.0) for s in shares]
    sketch = F.percentile_approx(value, around, ACCURACY)
    return F.struct(
        n.alias("n"),
        F.when(n < SMALL, F.array_repeat(low, parts)).otherwise(F.slice(sketch, 1, parts)).alias("low"),
        F.when(n < SMALL, F.array_repeat(high, parts)).otherwise(F.slice(sketch, parts + 1, parts)).alias("high"),
    )


def _narrower(column: str, low: float, high: float, place: float, inside: int) -> Column:
    """A bracket within [low, high] around the 0-based ``place`` among its ``inside`` rows."""
    value = F.col(column).cast("double")
    reach = MARGIN + 2.0 / inside
    around = [max(place / inside - reach, 0.0), min(place / inside + reach, 1.0)]
    return F.percentile_approx(F.when(value.between(low, high), value), around, ACCURACY)
