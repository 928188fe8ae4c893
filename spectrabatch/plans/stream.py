"""Continuous scoring (survey section 2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from ..session import scratch_dir
from ..sources.tables import read_parquet
from ..streaming import scoring
from .base import ORACLES, SQL_PREDICTIONS, first_prediction, query, second_prediction
from .scoring import SQL_BAND
from .statistics import rounded_columns


@query(
    "stream_scoring",
    f"""SELECT event_id, round_even(pred_a, 2) + 0.0 AS predicted_concentration, {SQL_BAND.format('pred_a')} AS confidence
        FROM {SQL_PREDICTIONS}""",
)
def stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the files that are there as a stream, append them to Parquet and read them back."""
    schema = read_parquet(spark, sf_dir, "events").schema
    arriving = scoring.read_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet*", schema)
    scored = scoring.score_values(arriving, "event_id", first_prediction())
    output = scratch_dir(spark, "scored")
    scoring.write_stream(scored, output, scratch_dir(spark, "scored-checkpoint")).awaitTermination()
    return spark.read.schema(scored.schema).parquet(output)


@query("stream_measured_history", ORACLES["history_runs"])
def stream_measured_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RMSE per day from a stream of predictions and a stream of values measured six hours later.

    The samples arrive in two parts, the second of which sends two days again; the
    stream stops between the parts and resumes from its checkpoint.
    """
    ts = F.col("ts").cast("timestamp")
    events = read_parquet(spark, sf_dir, "events")
    predicted = events.select("event_id", ts.alias("ts"), first_prediction().alias("pred_a"), second_prediction().alias("pred_b"))
    measured = events.select("event_id", (ts + F.expr("INTERVAL 6 HOURS")).alias("measured_at"), "value")
    folder, schemas = scratch_dir(spark, "measured"), {"predicted": predicted.schema, "measured": measured.schema}
    days = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    half = F.lit(days["first"] + (days["last"] - days["first"]) / 2).cast("timestamp")

    def streamed(name: str, time: str) -> DataFrame:
        return scoring.without_repeats(scoring.read_stream(spark, f"{folder}/{name}", schemas[name]), "event_id", time, "4 days")

    for part in ("early", "late"):
        for name, rows, time in (("predicted", predicted, "ts"), ("measured", measured, "measured_at")):
            chosen = F.col(time) < half if part == "early" else F.col(time) >= half - F.expr("INTERVAL 2 DAYS")
            rows.where(chosen).write.mode("append").parquet(f"{folder}/{name}")
        met = scoring.with_measured(streamed("predicted", "ts"), streamed("measured", "measured_at"), "event_id", "ts", "measured_at", "1 DAY")
        scoring.write_stream(met, f"{folder}/met", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.schema(met.schema).parquet(f"{folder}/met")
    runs = evaluation.run_history(found, F.date_trunc("day", "ts"), "value", {"elasticnet": "pred_a", "pls": "pred_b"})
    return rounded_columns(runs.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")), "elasticnet_rmse", "pls_rmse")
