"""Registration of queries and the stand-in tables they run on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.numeric import hours_between
from ..sources.tables import read_parquet

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query and, where SQL can say it, the equivalent statement."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# Spectra: 64 points, 200, 230, ... 2090.
POINTS = 64
AXIS = [200.0 + 30.0 * i for i in range(POINTS)]
BATCH_LABELS = list(range(10))

PROCESS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time samples: key event_id, batch user_id, hours since the first sample, target value."""
    events = read_parquet(spark, sf_dir, "events")
    start = events.agg(F.min("ts")).scalar()
    return events.select("event_id", "user_id", hours_between(start, F.col("ts")).alias("time_h"), "value")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, sf_dir, "events").select("event_id", "user_id", "value")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, sf_dir, "lineitem")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra: key vec_id, batch label, spectrum as array of double."""
    table = read_parquet(spark, sf_dir, "embeddings")
    return table.select("vec_id", "label", arrays.as_double(F.col("embedding")).alias("spectrum"))


def wide_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one column per wavenumber, named by it."""
    points = [F.get("spectrum", F.lit(i)).alias(f"{int(w)}") for i, w in enumerate(AXIS)]
    return spectra(spark, sf_dir).select("vec_id", "label", *points)


# Two fixed models, so that no fit enters a compared result.
def first_prediction() -> Column:
    return F.col("value") * 0.98 + (F.pmod(F.col("event_id") * 7919, F.lit(101)) - 50) / F.lit(100.0)


def second_prediction() -> Column:
    return F.col("value") * 1.01 + (F.pmod(F.col("event_id") * 104729, F.lit(97)) - 48) / F.lit(80.0)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual value and the predictions of both models per sample."""
    return targets(spark, sf_dir).withColumns({"pred_a": first_prediction(), "pred_b": second_prediction()})


SQL_SAMPLES = """(
    SELECT event_id, user_id, value,
           (epoch_us(ts) - epoch_us((SELECT min(ts) FROM events))) / 1000000.0 / 3600.0 AS time_h
    FROM events)"""

SQL_PREDICTIONS = """(
    SELECT event_id, user_id, value,
           value * 0.98 + ((event_id * 7919) % 101 - 50) / 100.0 AS pred_a,
           value * 1.01 + ((event_id * 104729) % 97 - 48) / 80.0 AS pred_b
    FROM events)"""

SQL_SPECTRA = "(SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS s FROM embeddings)"


def sql_round(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0)"


def sql_long(source: str, points: int, first_wl: float, keys: str = "vec_id", digits: int = 9) -> str:
    """Rows (keys, wl, intensity) from a relation with the spectrum in ``s``."""
    return f"""
    SELECT {keys}, CAST({first_wl} + 30.0 * (i - 1) AS DOUBLE) AS wl, {sql_round('s[i]', digits)} AS intensity
    FROM (SELECT *, unnest(range(1, {points} + 1)) AS i FROM {source})"""
