"""Registration that is stopped between any two writes and repeated."""

import pytest
from pyspark.sql import functions as F

from spectrabatch.sources import registry_store


class Stopped(Exception):
    pass


def submission(spark, rows):
    return spark.createDataFrame(rows, "submission long, model_name string, r2 double, rmse double, mae double").select(
        "submission", "model_name", F.lit("Hybrid").alias("model_type"), F.lit("d").alias("description"),
        F.lit("me").alias("created_by"), F.lit("f").alias("file_path"), F.lit("h").alias("file_hash"),
        F.struct(F.col("r2").alias("r2_score"), "rmse", "mae").alias("performance_metrics"),
        F.struct(F.lit(3).alias("layers")).alias("parameters"), F.struct(F.lit(4000).alias("training_samples")).alias("data_info"),
    )


def contents(store):
    """All rows without their times of writing."""
    return {
        name: sorted(tuple(str(r[c]) for c in r.asDict() if not c.endswith("_date")) for r in store.table(name).collect())
        for name in registry_store.SCHEMAS
    }


FIRST = [(5, "PLS", 0.9, 1.0, 0.8), (9, "Weak", 0.5, 1.0, 0.8)]
SECOND = [(1, "PLS", 0.9, 1.0, 0.8), (2, "Hybrid", 0.8, 1.9, 1.0), (3, "Net", 0.95, 0.5, 0.4)]
THIRD = [(1, "Net", 0.1, 9.0, 9.0), (2, "Tree", 0.8, 1.0, 1.0)]


@pytest.fixture(scope="module")
def uninterrupted(spark, tmp_path_factory):
    store = registry_store.Registry(spark, str(tmp_path_factory.mktemp("whole")))
    for name, rows in (("a", FIRST), ("b", SECOND), ("c", THIRD)):
        store.register(submission(spark, rows), name)
    return contents(store)


# the journal, four tables, the list of finished batches
@pytest.mark.parametrize("writes, after", [*((n, "the same batch") for n in range(6)), (1, "another batch"), (4, "another batch")])
def test_stopped_and_repeated(spark, tmp_path, monkeypatch, uninterrupted, writes, after):
    folder = str(tmp_path / "registry")
    registry_store.Registry(spark, folder).register(submission(spark, FIRST), "a")
    stopped, done = registry_store.Registry(spark, folder), []
    write = stopped._write

    def some(name, batch, rows):
        if len(done) == writes:
            raise Stopped
        write(name, batch, rows)
        done.append(name)

    monkeypatch.setattr(stopped, "_write", some)
    with pytest.raises(Stopped):
        stopped.register(submission(spark, SECOND), "b")
    store = registry_store.Registry(spark, folder)
    if after == "the same batch":
        assert store.register(submission(spark, SECOND), "b") == 2
    assert store.register(submission(spark, THIRD), "c") == 1
    assert contents(store) == uninterrupted
    assert store.register(submission(spark, SECOND), "b") == 0 and store.recover() == []


def test_names_differ_by_run_without_a_batch(spark, tmp_path):
    store = registry_store.Registry(spark, str(tmp_path / "registry"))
    assert store.register(submission(spark, FIRST)) == 2 and store.register(submission(spark, FIRST)) == 0
    assert store.register(submission(spark, [(1, None, 0.9, 1.0, 0.8)])) == 0
    assert store.table("models").count() == 2 and store.finished().count() == 1
