"""Filters, aggregates and histograms (survey sections 2.4 and 2.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import profiles, sampling, schema
from ..operators import statistics as stats
from ..session import scratch_dir
from .base import ORACLES, PROCESS, SQL_SAMPLES, lineitem, query, samples, sql_round, targets


def rounded_columns(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def sql_bin(value: str, low: str, high: str, bins: int) -> str:
    """1-based half-open bin by comparing with every edge."""
    edges = " + ".join(
        f"CAST({value} >= {high if i == bins else f'{low} + {i} * (({high} - {low}) / {float(bins)})'} AS BIGINT)"
        for i in range(1, bins + 1)
    )
    return f"(1 + {edges})"


def sql_closed_bin(value: str, low: str, high: str, bins: int) -> str:
    return f"least({sql_bin(value, low, high, bins)}, {bins})"


@query(
    "batch_stats",
    f"""SELECT user_id, count(*) AS samples, {sql_round('avg(value)')} AS avg_target,
              {sql_round('stddev_samp(value)')} AS std_target, min(value) AS min_target, max(value) AS max_target,
              {sql_round('min(time_h)')} AS min_time, {sql_round('max(time_h)')} AS max_time
       FROM {SQL_SAMPLES} GROUP BY user_id""",
)
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = stats.batch_stats(samples(spark, sf_dir), "user_id", "value", "time_h")
    return rounded_columns(result, "avg_target", "std_target", "min_time", "max_time")


@query("batch_keys", "SELECT DISTINCT user_id FROM events ORDER BY user_id")
def batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.batch_keys(targets(spark, sf_dir), "user_id")


@query("batch_select", "SELECT event_id, user_id, value FROM events WHERE user_id IN (1, 2, 3, 4)")
def batch_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.batch_select(targets(spark, sf_dir), "user_id", [1, 2, 3, 4])


@query("outlier_filter", "SELECT event_id, value FROM events WHERE value BETWEEN 0.5 AND 25.0")
def outlier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = sampling.REALISTIC_RANGE
    return targets(spark, sf_dir).where(F.col("value").between(low, high)).select("event_id", "value")


@query(
    "describe_variables",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS variable, count({c}) AS count, {sql_round(f'avg({c})')} AS mean,
              {sql_round(f'stddev_samp({c})')} AS std, min({c}) AS min, {sql_round(f'quantile_cont({c}, 0.25)')} AS p25,
              {sql_round(f'quantile_cont({c}, 0.5)')} AS p50, {sql_round(f'quantile_cont({c}, 0.75)')} AS p75,
              max({c}) AS max
            FROM lineitem"""
        for c in PROCESS
    ),
)
def describe_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = stats.describe(lineitem(spark, sf_dir), PROCESS)
    return rounded_columns(result, "mean", "std", "p25", "p50", "p75")


@query(
    "target_overview",
    f"""SELECT count(value) AS n, min(value) AS min, max(value) AS max, {sql_round('avg(value)')} AS mean,
              {sql_round('stddev_samp(value)')} AS std, {sql_round('median(value)')} AS median
       FROM events""",
)
def target_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(stats.target_overview(targets(spark, sf_dir), "value"), "mean", "std", "median")


@query(
    "campaign_trajectories",
    f"SELECT user_id, {sql_round('time_h')} AS time_h, value FROM {SQL_SAMPLES}",
)
def campaign_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(stats.trajectories(samples(spark, sf_dir), "user_id", "time_h", "value"), "time_h")


@query(
    "campaign_trajectory_buckets",
    f"""SELECT user_id, CAST(floor(time_h / 24.0) AS BIGINT) AS bucket, count(*) AS n,
              {sql_round('avg(value)')} AS avg_value
       FROM {SQL_SAMPLES} GROUP BY ALL""",
)
def campaign_trajectory_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = stats.trajectory_buckets(samples(spark, sf_dir), "user_id", "time_h", "value", 24.0)
    return rounded_columns(result, "avg_value")


@query(
    "target_histogram",
    f"""SELECT {sql_closed_bin('value', 'lo', 'hi', 30)} AS bin, count(*) AS n
       FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY ALL""",
)
def target_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(targets(spark, sf_dir), "value", 30)


@query(
    "batch_histogram",
    f"""SELECT user_id, {sql_closed_bin('value', 'lo', 'hi', 20)} AS bin, count(*) AS n
       FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY ALL""",
)
def batch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(targets(spark, sf_dir), "value", 20, ["user_id"])


@query(
    "multi_histogram",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS variable, {sql_closed_bin(c, 'lo', 'hi', 15)} AS bin, count(*) AS n
            FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY ALL"""
        for c in PROCESS
    ),
)
def multi_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.multi_histogram(lineitem(spark, sf_dir), PROCESS, 15)


@query(
    "threshold_counts",
    """SELECT count(*) FILTER (value > 1) AS above_1, count(*) FILTER (value > 5) AS above_5,
              count(*) FILTER (value > 10) AS above_10,
              count(*) FILTER (value >= 0 AND value < 5) AS band_low,
              count(*) FILTER (value >= 5 AND value < 15) AS band_medium,
              count(*) FILTER (value >= 15 AND value <= 25) AS band_high
       FROM events""",
)
def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.threshold_counts(targets(spark, sf_dir), "value", [1, 5, 10])


@query(
    "target_correlations",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS variable, {sql_round(f'corr({c}, l_extendedprice)')} AS correlation FROM lineitem"
        for c in PROCESS
        if c != "l_extendedprice"
    ),
)
def target_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    variables = [c for c in PROCESS if c != "l_extendedprice"]
    return rounded_columns(
        stats.target_correlations(lineitem(spark, sf_dir), variables, "l_extendedprice"), "correlation"
    )


@query(
    "rename_plain",
    "SELECT event_id AS sample_no, user_id AS batch_id, value AS penicillin_concentration_p_g_l FROM events",
)
def rename_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Original headers, made safe for SQL."""
    from ..functions.names import BATCH, TARGET, plain_names

    original = targets(spark, sf_dir).toDF("Sample (no)", BATCH, TARGET)
    return schema.rename_all(original, plain_names(original.columns))


def profiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, profiles.ProfileStore]:
    """The sample table and a store that got it year by year, the first year twice."""
    rows = lineitem(spark, sf_dir)
    store = profiles.ProfileStore(spark, scratch_dir(spark, "profiles"))
    years = [("early", "l_shipdate < '1995-01-01'"), ("late", "l_shipdate >= '1995-01-01'"), ("unknown", "l_shipdate is null")]
    for part, test in [*years, years[0]]:
        store.add(rows.where(test), PROCESS, part)
    return rows, store


@query("describe_from_profiles", ORACLES["describe_variables"])
def describe_from_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, store = profiled(spark, sf_dir)
    return rounded_columns(store.describe(rows), "mean", "std", "p25", "p50", "p75")


@query(
    "histogram_from_profiles",
    f"""SELECT {sql_closed_bin('l_extendedprice', 'lo', 'hi', 30)} AS bin, count(*) AS n
       FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY ALL""",
)
def histogram_from_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, store = profiled(spark, sf_dir)
    return stats.histogram(rows, "l_extendedprice", 30, known=store.value_range("l_extendedprice"))
