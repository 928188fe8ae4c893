"""Streams that are stopped, repeated and fed twice against the rows of a batch query."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spectrabatch.operators import evaluation
from spectrabatch.sources import history
from spectrabatch.streaming import scoring as stream

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def test_repeated_samples_and_later_measurements(spark, tmp_path):
    predicted, measured, out, check = (str(tmp_path / n) for n in ("predicted", "measured", "out", "check"))
    schemas = {predicted: "id long, at timestamp, guess double", measured: "id long, seen timestamp, value double"}

    def arrive(path, rows):
        spark.createDataFrame(rows, schemas[path]).write.mode("append").parquet(path)

    def run():
        one, two = (stream.without_repeats(stream.read_stream(spark, p, schemas[p]), "id", t, "10 hours") for p, t in ((predicted, "at"), (measured, "seen")))
        stream.write_stream(stream.with_measured(one, two, "id", "at", "seen", "5 HOURS"), out, check).awaitTermination()
        return sorted((r["id"], r["guess"], r["value"]) for r in spark.read.parquet(out).collect())

    arrive(predicted, [(1, at(0), 1.0), (1, at(0), 1.0), (2, at(1), 2.0), (3, at(1), 3.0)])
    arrive(measured, [(1, at(2), 1.5), (9, at(2), 9.0)])
    assert run() == [(1, 1.0, 1.5)]
    # sent again after a restart; a measurement that came late, one too long after, one before its prediction
    arrive(predicted, [(1, at(0), 1.0), (2, at(1), 2.0), (4, at(3), 4.0)])
    arrive(measured, [(1, at(2), 1.5), (2, at(4), 2.5), (3, at(9), 3.5), (4, at(2), 4.5)])
    expected = [(1, 1.0, 1.5), (2, 2.0, 2.5)]
    assert run() == expected
    assert run() == expected  # nothing new
    arrive(predicted, [(5, at(100), 5.0)])
    arrive(measured, [(5, at(101), 5.5)])
    assert run() == [*expected, (5, 5.0, 5.5)]
    arrive(predicted, [(2, at(1), 2.0)])  # its state is gone, but it is too late to count
    arrive(measured, [(2, at(4), 2.5)])
    assert run() == [*expected, (5, 5.0, 5.5)]

    runs = evaluation.run_history(spark.read.parquet(out), F.date_trunc("day", "at"), "value", {"elasticnet": "guess", "pls": "guess"})
    assert [(r["num_spectra"], round(r["pls_rmse"], 6)) for r in runs.collect()] == [(2, 0.5), (1, 0.5)]


def runs_of(spark, days):
    return spark.createDataFrame([(at(24 * d), 3, 0.5, 0.25) for d in days], history.SCHEMA)


def test_a_repeated_append_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "history")
    history.append(runs_of(spark, [0]), path)
    for _ in range(2):
        history.append(runs_of(spark, [1, 2]), path, "batch-1")
    assert [r["timestamp"] for r in history.read(spark, path).collect()] == [at(0), at(24), at(48)]
    history.clear(spark, path)
    assert history.read(spark, path).count() == 0


def test_micro_batches_are_appended_once(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("in", "history", "check"))
    for days in ([0, 1], [2]):
        runs_of(spark, days).write.mode("append").parquet(source)
        stream.write_history(stream.read_stream(spark, source, history.SCHEMA), path, check).awaitTermination()
    history.append(runs_of(spark, [2]), path, "batch-1")  # as a repeated micro-batch would
    assert [r["timestamp"] for r in history.read(spark, path).collect()] == [at(0), at(24), at(48)]
