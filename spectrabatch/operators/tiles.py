"""Spectra as a matrix of tiles, transposed without a column per sample.

A tile holds ``ROWS`` samples by ``COLUMNS`` points as one array, with the labels
of both. Turning a tile around stays inside its task; tiles meet again by row of
the new matrix, or stay apart as pieces where such a row would be too long for
one array. Every task and every row of the shuffle is bounded by the tile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import arrays
from ..functions.names import quoted
from . import rank_index

ROWS = 512
COLUMNS = 256
LONGEST = 50_000_000  # values of one joined row: 400 MB


def tiled(df: DataFrame, key: str, spectrum: str, axis: Sequence[float], rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """The samples in key order as tiles: ``row_block, column_block, row_labels, column_labels, data``.

    ``data`` runs row by row. Keys have to be unique, and every spectrum has to
    have the length of the axis: both are errors otherwise. Values that are NULL
    stay NULL.
    """
    points = len(axis)
    checked = F.when(F.size(spectrum) == points, F.col(spectrum).cast("array<double>")).otherwise(
        F.raise_error(F.format_string(f"sample %s has not {points} values", quoted(key).cast("string")))
    )
    narrow = df.select(quoted(key).alias("_label"), checked.alias("_values"))
    started = rank_index.build(df.select(quoted(key)), key).with_start(narrow.withColumnRenamed("_label", key))
    in_cell = W.partitionBy("_start").orderBy(quoted(key))
    # Copies of a key lie in one cell, so the row before tells them.
    twice = F.lag(quoted(key)).over(in_cell) == quoted(key)
    place = F.col("_start") + F.row_number().over(in_cell) - 1
    numbered = started.select(
        quoted(key).alias("_label"), "_values",
        F.when(F.coalesce(twice, F.lit(False)), F.raise_error(F.lit(f"a transpose needs unique values of {key}")).cast("long"))
        .otherwise(place).alias("_place"),
    )
    blocks = -(-points // columns)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0))), lambda b: F.slice("_values", b * columns + 1, columns))
    cut = numbered.select(
        F.floor(F.col("_place") / rows).cast("long").alias("row_block"), (F.col("_place") % rows).alias("_row"), "_label",
        F.posexplode(pieces).alias("column_block", "_piece"),
    )
    # At most rows x columns values meet in a group.
    held = cut.groupBy("row_block", "column_block").agg(F.sort_array(F.collect_list(F.struct("_row", "_label", "_piece"))).alias("_rows"))
    labels = F.slice(arrays.literal(axis), F.col("column_block") * columns + 1, columns)
    return held.select(
        "row_block", F.col("column_block").cast("long").alias("column_block"), F.col("_rows._label").alias("row_labels"),
        labels.alias("column_labels"), F.flatten("_rows._piece").alias("data"),
    )


def turned(tiles: DataFrame) -> DataFrame:
    """The transposed matrix in the same layout: rows become columns, no shuffle."""
    kinds = {f.name: f.dataType for f in tiles.schema}
    schema = T.StructType([
        T.StructField("row_block", T.LongType()), T.StructField("column_block", T.LongType()),
        T.StructField("row_labels", kinds["column_labels"]), T.StructField("column_labels", kinds["row_labels"]),
        T.StructField("data", T.ArrayType(T.DoubleType())),
    ])
    return tiles.mapInArrow(_turn, schema)


def _turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Tile by tile: a batch of tiles would be ten thousand of them.
        for i in range(batch.num_rows):
            row = {name: batch.column(name).slice(i, 1) for name in batch.schema.names}
            values, height = row["data"].flatten(), len(row["row_labels"].flatten())
            order = np.arange(len(values)).reshape(height, -1).T.ravel()
            data = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays(
                [row["column_block"], row["row_block"], row["column_labels"], row["row_labels"], data],
                ["row_block", "column_block", "row_labels", "column_labels", "data"],
            )


def pieces(tiles: DataFrame, label: str, labels: str = "labels", values: str = "values") -> DataFrame:
    """Row by row, in pieces: ``label, block, labels, values`` with the labels and values of one tile's width."""
    width = F.size("column_labels")
    at = F.posexplode("row_labels").alias("_at", label)
    opened = tiles.select("column_block", "column_labels", "data", at)
    piece = F.slice("data", F.col("_at") * width + 1, width)
    return opened.select(label, F.col("column_block").alias("block"), F.col("column_labels").alias(labels), piece.alias(values))


def joined(tiles: DataFrame, label: str, values: str = "values") -> DataFrame:
    """One row per row of the matrix: ``label, values`` in column order.

    Rows of more than ``LONGEST`` values are an error; :func:`pieces` has no limit.
    """
    blocks, width = tiles.agg(F.max("column_block") + 1, F.max(F.size("column_labels"))).first()
    if (blocks or 0) * (width or 0) > LONGEST:
        raise ValueError(f"rows of up to {blocks * width} values do not fit one array; use pieces")
    parts = F.sort_array(F.collect_list(F.struct("block", values)))
    return pieces(tiles, label, "_labels", values).groupBy(label).agg(F.flatten(parts[values]).alias(values))
