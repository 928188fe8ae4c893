"""A stored table of key cells with their row counts: exact positions at any size.

Every key has a whole number, its code, in the same order. A cell holds the
codes that agree in their leading binary digits. Cells with too many rows are
divided by the next digits, level by level, each level in one pass over the
rows of such cells only, so also a key that crowds in a few places ends in small
cells. Cells, counts and starts stay in a table, which rows meet in a join; the
driver sees three numbers a level, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.names import quoted
from ..session import scratch_dir

CELL_ROWS = 1_000_000
MIN_CELLS = 16
MOST_BITS = 12  # a cell is divided into at most 4,096, which one window orders

CELLS = "level int, prefix long, low long, high long, start long, n long"
FACTS = "key string, kind string, origin long, halved boolean, shifts array<int>, n long"


def code(key: Column, kind: T.DataType) -> Column:
    """A whole number that never falls as the key rises; keys of one code are told apart by themselves."""
    if isinstance(kind, T.IntegralType):
        return key.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(key.cast("timestamp"))
    if not isinstance(kind, (T.FractionalType, T.DecimalType)):
        raise TypeError(f"a key of type {kind.simpleString()} has no position")
    # The logarithm of a double lies between -745 and 710; its order is kept by adding and scaling.
    x = key.cast("double")
    size = F.floor((F.log(F.abs(x)) + 746.0) * float(2**42)).cast("long")
    most = F.lit(2**62)
    finite = F.when(x == 0, F.lit(0)).when(F.abs(x) == math.inf, most).otherwise(size)
    return F.when(F.isnan(x), most + 1).when(x < 0, -finite).otherwise(finite).cast("long")


@dataclass(frozen=True)
class RankIndex:
    """Cells of a key: level, leading digits, range of codes, rows before the cell, and its rows."""

    cells: DataFrame
    key: str
    kind: T.DataType
    origin: int
    halved: bool
    shifts: Sequence[int]
    n: int

    def place(self) -> Column:
        """The code of a key, counted from the smallest one."""
        return _place(code(quoted(self.key), self.kind), self.origin, self.halved)

    def with_start(self, df: DataFrame, name: str = "_start") -> DataFrame:
        """Adds the number of rows before the row's cell, which also names the cell.

        One join by equality for every level; Spark broadcasts the cells by their
        measured size. All keys of ``df`` have to be in the indexed table.
        """
        out, found = df.withColumn("_place", self.place()), []
        for level, shift in enumerate(self.shifts):
            at, start = f"_at{level}", f"_start{level}"
            held = self.cells.where(F.col("level") == level).select(F.col("prefix").alias(at), F.col("start").alias(start))
            out = out.withColumn(at, F.shiftright("_place", shift)).join(held, at, "left").drop(at)
            found.append(start)
        missing = F.raise_error(F.lit(f"a value of {self.key} is not in the index")).cast("long")
        return out.withColumn(name, F.coalesce(*found, missing)).drop("_place", *found)

    def with_position(self, df: DataFrame, name: str = "position") -> DataFrame:
        """1-based position of every row of the indexed table."""
        rank = F.row_number().over(W.partitionBy("_start").orderBy(quoted(self.key)))
        return self.with_start(df).withColumn(name, F.col("_start") + rank).drop("_start")

    def touched(self, first: int, last: int) -> DataFrame:
        """The cells with rows at the 0-based positions ``first`` (included) to ``last`` (excluded)."""
        return self.cells.where((F.col("start") < last) & (F.col("start") + F.col("n") > first))

    def slice(self, df: DataFrame, first: int, last: int, name: str | None = None) -> DataFrame:
        """The rows at 0-based positions ``first`` to ``last`` (excluded), reading their cells only.

        For whole-number keys the range is a filter on the key itself, so it
        reaches the scan; a table sorted by its key skips everything else.
        """
        ends = self.touched(first, last).agg(F.min("low"), F.max("high")).first()
        if ends[0] is None:
            return self.with_position(df.limit(0), name or "_position").drop(*([] if name else ["_position"]))
        numbered = self.with_position(df.where(self._between(*ends)), "_position")
        inside = numbered.where(F.col("_position").between(first + 1, last))
        return inside.withColumnRenamed("_position", name) if name else inside.drop("_position")

    def _between(self, low: int, high: int) -> Column:
        if isinstance(self.kind, T.IntegralType) and not self.halved:
            most = {T.ByteType: 2**7, T.ShortType: 2**15, T.IntegerType: 2**31}.get(type(self.kind), 2**63) - 1
            ends = (F.lit(min(self.origin + end, most)).cast(self.kind) for end in (low, high))
            return quoted(self.key).between(*ends)
        return self.place().between(low, high)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> RankIndex:
        """An index that :func:`build` left in a folder."""
        facts = spark.read.schema(FACTS).parquet(f"{folder}/facts").first()
        cells = spark.read.schema(CELLS).parquet(f"{folder}/cells")
        kind = T.StructType.fromDDL(f"k {facts['kind']}")[0].dataType
        return RankIndex(cells, facts["key"], kind, facts["origin"], facts["halved"], facts["shifts"], facts["n"])


def _place(codes: Column, origin: int, halved: bool) -> Column:
    # Two longs may be further apart than a long can say; then the last digit is dropped.
    return (F.shiftright(codes, 1) if halved else codes) - F.lit(origin)


def build(df: DataFrame, key: str, folder: str | None = None, cell_rows: int | None = None, min_cells: int | None = None) -> RankIndex:
    """Count the rows of ``df`` into cells of at most ``cell_rows`` (copies of one code stay together).

    Level by level: the crowded cells of a level are joined with the rows, whose
    next digits are counted. The number of digits follows the fullest cell. The
    start of a child is its parent's and the rows of its elder siblings, so no
    window holds more than 4,096 cells. With a ``folder``, ``RankIndex.open`` finds
    the index again; otherwise its levels lie in the scratch folder.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    keep, folder = folder is not None, folder or scratch_dir(spark, "rank-index")
    coded = df.select(code(quoted(key), kind).alias("_code"))
    n, missing, least, most = coded.agg(
        F.count(F.lit(1)), F.count_if(F.col("_code").isNull()), F.min("_code"), F.max("_code")
    ).first()
    if missing:
        raise ValueError(f"{key} is missing in {missing} rows, which have no position")
    least, most = (least, most) if n else (0, 0)
    halved = most - least >= 2**63
    origin, end = (least >> 1, most >> 1) if halved else (least, most)
    places = coded.select(_place(F.col("_code"), origin, halved).alias("_place"))
    limit = max(min(n // (min_cells or MIN_CELLS), cell_rows or CELL_ROWS), 1)

    shift, shifts, parts = (end - origin).bit_length(), [], []
    crowded, fullest = None, n
    while True:
        bits = min(shift, MOST_BITS, max(math.ceil(math.log2(max(fullest, 1) / limit)), 0) + 1)
        prefix = F.shiftright("_place", shift - bits).alias("prefix")
        held = places.withColumn("parent", F.shiftright("_place", shift))
        held = held if crowded is None else held.join(crowded.select("parent"), "parent", "left_semi")
        counted = held.groupBy("parent", prefix).agg(F.count(F.lit(1)).alias("n"))
        elder = W.partitionBy("parent").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(elder), F.lit(0))
        children = counted.withColumn("before", before)
        children = children.withColumn("offset", F.lit(0)) if crowded is None else children.join(crowded, "parent")
        shift -= bits
        low = F.shiftleft("prefix", shift)
        level = f"{folder}/levels/{len(shifts)}"
        children.select(
            F.lit(len(shifts)).alias("level"), "prefix", low.alias("low"), (low + F.lit((1 << shift) - 1)).alias("high"),
            (F.col("offset") + F.col("before")).alias("start"), "n",
        ).write.mode("overwrite").parquet(level)
        shifts.append(shift)
        cells = spark.read.schema(CELLS).parquet(level)
        full = F.col("n") > limit
        parts.append(cells.where(~full) if shift else cells)
        fullest = cells.agg(F.max("n")).first()[0] or 0
        if not shift or fullest <= limit:
            break
        crowded = cells.where(full).select(F.col("prefix").alias("parent"), F.col("start").alias("offset"))
    leaves = reduce(DataFrame.unionAll, parts)
    if keep:
        leaves.write.mode("overwrite").parquet(f"{folder}/cells")
        facts = spark.createDataFrame([(key, kind.simpleString(), origin, halved, shifts, n)], FACTS).coalesce(1)
        facts.write.mode("overwrite").parquet(f"{folder}/facts")
    return RankIndex(leaves, key, kind, origin, halved, shifts, n)
