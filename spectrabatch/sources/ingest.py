"""Reading dirty files: every row is either clean or kept with its file, text and reason."""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import validate_length
from .tables import CSV_OPTIONS

CORRUPT = "_corrupt_record"
NO_SEPARATOR = "\x1e\x1f\x1e"  # signs that no line holds, so a line is one field
NAMED = 3  # columns named in a reason; the rest is counted


def _csv_reason(line: str, names: Sequence[str], numbers: set[str]) -> str:
    """What is wrong with a line, as far as a plain reader can tell."""
    try:
        fields = next(csv.reader([line]), [])
    except csv.Error as error:
        return f"no CSV: {error}"
    if len(fields) != len(names):
        return f"{len(fields)} fields, expected {len(names)}"
    broken = [f"{name}: '{field}' is no number" for name, field in zip(names, fields) if name in numbers and not _is_number(field)]
    more = f" and {len(broken) - NAMED} more" if len(broken) > NAMED else ""
    return "; ".join(broken[:NAMED]) + more if broken else "not readable by the schema"


def _is_number(text: str) -> bool:
    try:
        return not text or float(text) is not None
    except ValueError:
        return False


def _json_reason(line: str) -> str:
    try:
        body = json.loads(line)
    except ValueError as error:
        return f"no JSON: {error}"
    if not isinstance(body, dict):
        return "no JSON object"
    number, values = body.get("request_id"), body.get("spectral_values")
    if number is not None and (isinstance(number, bool) or not isinstance(number, int)):
        return "request_id is no whole number"
    if values is not None and not isinstance(values, list):
        return "spectral_values is no list"
    for at, value in enumerate(values or []):
        if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float))):
            return f"spectral_values[{at}] is no number"
    return "not readable by the schema"


def _once(parsed: Column) -> Column:
    """The parsed struct as generated row: a filter on it is then not a second parse."""
    return F.explode(F.array(parsed)).alias("_row")


def read_samples_checked(spark: SparkSession, path: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and rejected rows ``(key, file, line, reason)`` of CSV files with a header.

    Rejected are rows with a field that is no value of its column, and rows with
    too few or too many fields. The key is given as far as it could be read. A
    reader that parses while it scans judges a row by the columns in use only;
    here lines are read whole (without each file's header) and parsed by one
    expression, so a row is always on the same side. Empty fields are NULL and
    clean; blank lines are no rows.
    """
    names = schema.fieldNames()
    numbers = {f.name for f in schema if isinstance(f.dataType, T.NumericType)}
    lines = spark.read.schema("line string").options(header="true", sep=NO_SEPARATOR, quote="", escape="", nullValue=NO_SEPARATOR).csv(path)
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    options = {"escape": CSV_OPTIONS["escape"], "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_csv("line", f"{kinds}, {CORRUPT} string", options)
    rows = lines.select("line", F.col("_metadata.file_path").alias("file"), _once(parsed))

    @F.pandas_udf(T.StringType())
    def reason(texts: pd.Series) -> pd.Series:
        return texts.map(lambda line: _csv_reason(line, names, numbers))

    broken = F.col(f"_row.{CORRUPT}").isNotNull()
    rejected = rows.where(broken).select(F.col("_row").getField(key).alias(key), "file", "line", reason("line").alias("reason"))
    return rows.where(~broken).select(*[F.col("_row").getField(n).alias(n) for n in names]), rejected


def read_requests_checked(spark: SparkSession, path: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Clean requests ``(request_id, spectrum)`` and rejected ones ``(request_id, file, line, reason)`` of JSON lines.

    Rejected are lines that are no JSON, values of another type, and spectra of
    another length. The number is given as far as it could be read; blank lines are
    no rows.
    """
    schema = f"request_id long, spectral_values array<double>, {CORRUPT} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", schema, options)
    rows = lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), _once(parsed)).select(
        "line", "file", "_row.request_id", F.col("_row.spectral_values").alias("spectrum"), F.col(f"_row.{CORRUPT}").isNotNull().alias("broken")
    )

    @F.pandas_udf(T.StringType())
    def reason(texts: pd.Series) -> pd.Series:
        return texts.map(_json_reason)

    broken = rows.where("broken").select("request_id", "file", "line", reason("line").alias("reason"))
    checked = validate_length(rows.where("not broken"), "request_id", "spectrum", length)
    wrong = checked.where(F.col("reason").isNotNull()).select("request_id", "file", "line", "reason")
    return checked.where(F.col("reason").isNull()).select("request_id", "spectrum"), broken.unionAll(wrong)
