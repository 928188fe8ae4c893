"""Continuous scoring: the single-sample service as a stream.

Scoring is stateless, so a stream of any length needs no watermark and keeps no
state; the checkpoint makes the file sink exactly-once. Samples that are sent twice
and measured values that come later need state: both steps hold rows for a bounded
event time only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import numeric
from ..operators.scoring import LinearModel, batch_scoring
from ..sources import history


def read_stream(spark: SparkSession, path: str, schema: StructType | str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def score_spectra(stream: DataFrame, key: str, spectrum: str, model: LinearModel) -> DataFrame:
    """Validate, clean, score and band every arriving spectrum."""
    return batch_scoring(stream, key, spectrum, model)


def score_values(stream: DataFrame, key: str, prediction: Column) -> DataFrame:
    """The same for samples with a single process value; non-finite results count as 0."""
    score = numeric.finite_or_zero(prediction)
    return stream.select(
        key,
        numeric.rounded_half_even(score, 2).alias("predicted_concentration"),
        numeric.confidence_band(score).alias("confidence"),
    )


def without_repeats(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Every sample once, however often it is sent within ``delay`` of its event time.

    Rows that are later than ``delay`` behind the newest one are dropped, and so is
    the state of keys that old. ``time`` is a timestamp column.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def with_measured(predicted: DataFrame, measured: DataFrame, key: str, time: str, measured_time: str, within: str) -> DataFrame:
    """Predictions with the value measured for them up to ``within`` later, as soon as both are there.

    Both streams need a watermark on their time (``without_repeats`` sets it); the
    time condition lets Spark drop predictions that can't be met any more. A
    prediction without a measurement gives no row.
    """
    later = measured.withColumnRenamed(key, f"measured_{key}")
    meets = (F.col(key) == F.col(f"measured_{key}")) & F.expr(f"`{measured_time}` BETWEEN `{time}` AND `{time}` + INTERVAL {within}")
    return predicted.join(later, meets).drop(f"measured_{key}")


def write_stream(scored: DataFrame, output: str, checkpoint: str, continuous: bool = False) -> StreamingQuery:
    """Append to Parquet; by default process what is there and stop."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if not continuous:
        writer = writer.trigger(availableNow=True)
    return writer.start(output)


def describe(query: StreamingQuery) -> dict:
    """Progress of the last trigger: rows in and milliseconds spent."""
    progress = query.lastProgress or {}
    return {"rows": progress.get("numInputRows", 0), "ms": (progress.get("durationMs") or {}).get("triggerExecution", 0)}


def write_history(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append runs to the history, each micro-batch under its number: one that is repeated after a failure replaces itself."""

    def append(rows: DataFrame, number: int) -> None:
        history.append(rows, path, f"batch-{number}")

    return runs.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
