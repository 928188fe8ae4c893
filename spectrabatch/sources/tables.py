"""Sample tables: CSV with an explicit schema, Parquet, file facts, requests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted

# Quotes inside text are doubled, as other CSV writers do.
CSV_OPTIONS = {"header": "true", "escape": '"'}


def read_parquet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def staged(df: DataFrame, folder: str) -> DataFrame:
    """The frame written once to a shared folder and read back."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table_or_none(spark: SparkSession, path: str, schema: T.StructType | str, nested: bool = False) -> DataFrame | None:
    """The Parquet table, or None if there is nothing at the path; other errors are raised.

    ``nested`` takes the files of all folders below the path as one table.
    """
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", nested).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header; without an inference pass over the data."""
    return spark.read.options(**CSV_OPTIONS).csv(path).columns


def read_samples_csv(spark: SparkSession, path: str, text_columns: Sequence[str] = ()) -> DataFrame:
    """Wide sample table: every column is double unless named as text."""
    text = set(text_columns)
    schema = T.StructType(
        [T.StructField(n, T.StringType() if n in text else T.DoubleType()) for n in csv_header(spark, path)]
    )
    return read_csv(spark, path, schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header and no index; one file per task, so nothing is gathered."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_packed(df: DataFrame, path: str, batch: str, partitions: int | None = None) -> None:
    """Parquet clustered by batch, so that a filter on the batch skips row groups.

    Range partitioning by batch and a spread key splits a batch, or a group of
    copies, that holds much of the table over several tasks; a directory per
    batch would not. The spread follows the input rows, so a repeated task
    sends them to the same place.
    """
    spread = df.withColumn("_spread", F.xxhash64(F.monotonically_increasing_id()))
    keys = [quoted(batch), F.col("_spread")]
    arranged = spread.repartitionByRange(partitions, *keys) if partitions else spread.repartitionByRange(*keys)
    arranged.drop("_spread").sortWithinPartitions(quoted(batch)).write.mode("overwrite").parquet(path)


def file_facts(df: DataFrame) -> DataFrame:
    """Name, size and modification time of the files behind a table."""
    return df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()


def requests_table(spark: SparkSession, spectra: Iterable[Sequence[float]]) -> DataFrame:
    """Request arrays to rows ``(request_id, spectrum)``; a request body is small by nature."""
    rows = [(i, [None if v is None else float(v) for v in s]) for i, s in enumerate(spectra)]
    return spark.createDataFrame(rows, "request_id long, spectrum array<double>")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"request_id": ..., "spectral_values": [...]}``."""
    schema = "request_id long, spectral_values array<double>"
    return spark.read.schema(schema).json(path).withColumnRenamed("spectral_values", "spectrum")
