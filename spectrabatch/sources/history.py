"""Append-only history of scoring runs.

Runs appended under a batch name live in a folder of that name, so a job that is
repeated after a failure replaces its own rows instead of adding them twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "timestamp timestamp, num_spectra long, elasticnet_rmse double, pls_rmse double"


def append(run: DataFrame, path: str, batch: str | None = None) -> None:
    rows = run.select("timestamp", "num_spectra", "elasticnet_rmse", "pls_rmse")
    if batch is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{batch}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(path).orderBy("timestamp")


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
