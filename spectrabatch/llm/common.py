"""Helpers of the training-data operators: tables, written intermediate results, distributed sums."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

#: What separates words: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared scratch folder and read back.

    Later jobs start from the files, also after executors were lost, and joins
    on them keep an exchange of their own that the adaptive skew split can cut.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(rows: int, per_slice: int) -> int:
    """Number of leading hash bits that cut this many rows into slices of about that size."""
    return max(1, math.ceil(math.log2(max(1, rows) / per_slice + 1)))


def slices_of(key: Column, rows: dict, per_slice: int) -> Column:
    """``slices`` per group, from the groups' row counts (one literal per group)."""
    entries = [F.lit(x) for group, n in rows.items() for x in (group, slices(n, per_slice))]
    return F.element_at(F.create_map(*entries), key) if entries else F.lit(1)


def running_start(df: DataFrame, group: list[str], digest: str, ties: list[str], values: dict[str, str], bits: Column) -> DataFrame:
    """Adds, for each ``new: value`` pair, the sum of ``value`` over the rows of the group that come before.

    Rows are ordered by the unsigned ``digest`` (a well spread 64-bit hash), then
    by ``ties``. The leading ``bits`` of the digest, as many as the group's size
    asks for, cut it into slices; one small row per slice carries the sum so far,
    and only the rows of one slice meet in a window, so no group is ever sorted in
    one task. ``group`` columns must not be null.
    """
    sliced = df.withColumn("_bits", 64 - bits).withColumn("_slice", F.expr(f"shiftrightunsigned({digest}, _bits)")).drop("_bits")
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, "_slice").orderBy(digest, *ties).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        sliced.groupBy(*group, "_slice")
        .agg(*[F.sum(value).alias(f"_sum_{new}") for new, value in values.items()])
        .select(*group, "_slice", *[F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_base_{new}") for new in values])
    )
    sums = {new: F.col(f"_base_{new}") + F.coalesce(F.sum(value).over(inside), F.lit(0)) for new, value in values.items()}
    return sliced.join(bases, [*group, "_slice"]).withColumns(sums).drop("_slice", *[f"_base_{new}" for new in values])


def first_by_hash(df: DataFrame, digest: str, count: int, *ties: str) -> DataFrame:
    """The first ``count`` rows by a well spread 64-bit hash.

    A bound on the hash that twice as many rows are expected to pass comes first,
    so what the tasks send on for the final order does not grow with the table.
    """
    place = F.shiftrightunsigned(digest, 1)
    rows = df.count()
    if rows > 2 * count:
        df = df.filter(place < int(2**63 * 2 * count / rows))
    return df.orderBy(place, *ties).limit(count)


def with_all_columns(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` on rows of documents, with every other column of theirs kept as it is.

    Columns that are not those of ``documents`` travel inside one struct, so that
    none can clash with a name the operator uses for itself.
    """
    others = [c for c in docs.columns if c not in DOCUMENT_COLUMNS]
    if not others:
        return operator(docs)
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns}
    own = [c for c in docs.columns if c in DOCUMENT_COLUMNS]
    done = operator(docs.select(*own, F.struct(*[F.col(quoted[c]) for c in others]).alias("other_columns")))
    return done.select(*[F.col(c) if c in own else F.col(f"other_columns.{quoted[c]}").alias(c) for c in docs.columns])
