"""Spectral operators (survey section 2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.numeric import rounded
from ..operators import spectral
from .base import AXIS, POINTS, SQL_SPECTRA, query, spectra, sql_long, sql_round

# 350 to 1750 keeps the points 5..51 of the stand-in axis.
CUT = 47
CUT_START = 350.0

SQL_CUT = f"(SELECT vec_id, label, s[6:52] AS s FROM {SQL_SPECTRA})"


def sql_stencil(source: str, taps: dict[int, str]) -> str:
    """Weighted neighbours with the end values repeated."""
    terms = " + ".join(f"({tap}) * s[greatest(1, least(len(s), i + ({offset})))]" for offset, tap in taps.items())
    return f"""(WITH src AS MATERIALIZED (SELECT * FROM {source})
                SELECT vec_id, label, [{terms} FOR i IN range(1, len(s) + 1)] AS s FROM src)"""


def sql_baseline(source: str) -> str:
    return f"""(WITH src AS MATERIALIZED (SELECT * FROM {source})
                SELECT vec_id, label,
                  [s[i] - (s[1] + (s[len(s)] - s[1]) / (len(s) - 1) * (i - 1)) FOR i IN range(1, len(s) + 1)] AS s
                FROM src)"""


# Five-point quadratic smoothing, three-point mean, slope over two points either side.
SQL_SAVGOL = {-2: "-3.0 / 35.0", -1: "12.0 / 35.0", 0: "17.0 / 35.0", 1: "12.0 / 35.0", 2: "-3.0 / 35.0"}
SQL_SEGMENT = {-1: "1.0 / 3.0", 0: "1.0 / 3.0", 1: "1.0 / 3.0"}
SQL_GAP = {-2: "-0.25", 2: "0.25"}


def sql_norris(source: str) -> str:
    return sql_stencil(sql_stencil(source, SQL_SEGMENT), SQL_GAP)


def sql_chain(cut: str) -> str:
    return sql_norris(sql_stencil(sql_baseline(cut), SQL_SAVGOL))


SQL_CHAIN = sql_chain(SQL_CUT)


def sql_scaled(source: str, points: int) -> str:
    """Long rows with zero mean and unit population deviation per point."""
    return f"""(SELECT vec_id, label, i,
                 (v - avg(v) OVER (PARTITION BY i)) /
                 CASE WHEN stddev_pop(v) OVER (PARTITION BY i) > 0 THEN stddev_pop(v) OVER (PARTITION BY i) ELSE 1 END AS z
               FROM (SELECT vec_id, label, unnest(range(1, {points} + 1)) AS i, unnest(s) AS v FROM {source}))"""


def long(df: DataFrame, axis: list[float], digits: int = 9) -> DataFrame:
    rows = spectral.to_long(df, ["vec_id"], "spectrum", axis)
    return rows.withColumn("intensity", rounded(F.col("intensity"), digits))


def cut_spectra(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    return spectral.range_cut(spectra(spark, sf_dir), "spectrum", AXIS, 350.0, 1750.0)


@query("range_cut", sql_long(SQL_CUT, CUT, CUT_START))
def range_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(*cut_spectra(spark, sf_dir))


@query("linear_baseline", sql_long(sql_baseline(SQL_CUT), CUT, CUT_START))
def linear_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, axis = cut_spectra(spark, sf_dir)
    return long(spectral.linear_baseline(cut, "spectrum", len(axis)), axis)


@query("savgol_smooth", sql_long(sql_stencil(SQL_CUT, SQL_SAVGOL), CUT, CUT_START))
def savgol_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, axis = cut_spectra(spark, sf_dir)
    return long(spectral.savgol_smooth(cut, "spectrum", len(axis)), axis)


@query("norris_williams", sql_long(sql_norris(SQL_CUT), CUT, CUT_START))
def norris_williams(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, axis = cut_spectra(spark, sf_dir)
    return long(spectral.norris_williams(cut, "spectrum", len(axis)), axis)


@query(
    "standard_scale",
    f"""SELECT vec_id, CAST(200.0 + 30.0 * (i - 1) AS DOUBLE) AS wl, {sql_round('z')} AS intensity
        FROM {sql_scaled(SQL_SPECTRA, POINTS)}""",
)
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long(spectral.standard_scale(spectra(spark, sf_dir), "spectrum"), AXIS, 6)


@query("spectral_chain", sql_long(SQL_CHAIN, CUT, CUT_START))
def spectral_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut, baseline, smoothing and derivative: the chain before scaling, as displayed."""
    return long(*spectral.preprocess(spectra(spark, sf_dir), "spectrum", AXIS))


@query(
    "spectral_chain_scaled",
    f"""SELECT vec_id, CAST({CUT_START} + 30.0 * (i - 1) AS DOUBLE) AS wl, {sql_round('z')} AS intensity
        FROM {sql_scaled(SQL_CHAIN, CUT)}""",
)
def spectral_chain_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain, as the models see it."""
    processed, axis = spectral.preprocess(spectra(spark, sf_dir), "spectrum", AXIS)
    return long(spectral.standard_scale(processed, "spectrum"), axis, 6)


@query(
    "two_block_scale",
    f"""SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, {sql_round('z')} AS scaled FROM {sql_scaled(SQL_SPECTRA, POINTS)}""",
)
def two_block_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process block (first four points) and spectral block, scaled apart and concatenated."""
    blocks = spectra(spark, sf_dir).select(
        "vec_id",
        arrays.position_slice(F.col("spectrum"), 0, 4).alias("process"),
        arrays.position_slice(F.col("spectrum"), 4, POINTS).alias("spectral"),
    )
    joined = spectral.scale_blocks(blocks, ["process", "spectral"], "features")
    rows = spectral.explode_points(joined, ["vec_id"], "features", "scaled")
    return rows.select("vec_id", F.col("_pos").cast("long").alias("pos"), rounded(F.col("scaled")).alias("scaled"))


@query(
    "batch_mean_spectrum",
    f"""SELECT label, CAST(200.0 + 30.0 * (i - 1) AS DOUBLE) AS wl, {sql_round('avg(v)')} AS mean_intensity
        FROM (SELECT label, unnest(range(1, {POINTS} + 1)) AS i, unnest(s) AS v FROM {SQL_SPECTRA}) GROUP BY label, i""",
)
def batch_mean_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = spectral.batch_mean_spectrum(spectra(spark, sf_dir), "label", "spectrum", AXIS)
    return means.withColumn("mean_intensity", rounded(F.col("mean_intensity")))
