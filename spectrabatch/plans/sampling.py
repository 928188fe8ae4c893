"""Samples, splits, folds and the test-set builders (survey sections 2.7 and 2.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import sampling, statistics as stats
from .base import query, targets
from .statistics import sql_bin

SEED = 42

SQL_HASH = f"md5(event_id || ':{SEED}')"
SQL_TEST_SIZE = "CAST(ceil((SELECT count(*) FROM events) * 0.2::DOUBLE) AS BIGINT)"
SQL_ORDERED = f"(SELECT event_id, user_id, value, row_number() OVER (ORDER BY {SQL_HASH}, event_id) AS place FROM events)"
SQL_HELD_OUT = f"(SELECT event_id, user_id, value FROM {SQL_ORDERED} WHERE place <= {SQL_TEST_SIZE})"


def sql_strata(source: str, bins: int = 10) -> str:
    return f"""(SELECT event_id, user_id, value, {sql_bin('value', 'lo', 'hi', bins)} AS bin, {SQL_HASH} AS h
                FROM {source}, (SELECT min(value) AS lo, max(value) AS hi FROM {source}))"""


def sql_random_picks(source: str, bins: int = 10, k: int = 10) -> str:
    return f"""(SELECT event_id, user_id, value, bin, h FROM {sql_strata(source, bins)} WHERE bin <= {bins}
                QUALIFY row_number() OVER (PARTITION BY bin ORDER BY h, event_id) <= {k})"""


def sql_systematic_picks(source: str, bins: int = 10, k: int = 10) -> str:
    return f"""(SELECT event_id, user_id, value, bin, h
                FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY event_id) AS rn,
                             greatest(count(*) OVER (PARTITION BY bin) // {k}, 1) AS step
                      FROM {sql_strata(source, bins)} WHERE bin <= {bins})
                WHERE (rn - 1) % step = 0 AND (rn - 1) // step < {k})"""


def sql_top_up(picks: str, pool: str, size: int = 100) -> str:
    return f"""
    WITH pool AS (SELECT * FROM {pool}), picks AS (SELECT * FROM {picks}),
    both_parts AS (
        SELECT event_id, user_id, value, bin, h, 0 AS part, 'picked' AS origin FROM picks
        UNION ALL
        SELECT event_id, user_id, value, NULL, {SQL_HASH}, 1, 'filled' FROM pool
        WHERE event_id NOT IN (SELECT event_id FROM picks))
    SELECT event_id, user_id, value, bin, origin FROM both_parts ORDER BY part, bin, h, event_id LIMIT {size}"""


SQL_REALISTIC_POOL = f"(SELECT * FROM {SQL_HELD_OUT} WHERE value BETWEEN 0.5 AND 25.0)"
SQL_DEMO_POOL = f"(SELECT * FROM {SQL_HELD_OUT} WHERE value BETWEEN 0.1 AND 25.0)"
SQL_REALISTIC = sql_top_up(sql_random_picks(SQL_REALISTIC_POOL), SQL_REALISTIC_POOL)


def _realistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = sampling.REALISTIC_RANGE
    return sampling.stratified_test_set(targets(spark, sf_dir), "event_id", "value", low, high, SEED)


@query("stratified_topup", SQL_REALISTIC)
def stratified_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The realistic test set: 20 % split, 0.5 to 25, ten strata of ten, filled to 100."""
    return _realistic(spark, sf_dir)


@query("demo_test_set", sql_top_up(sql_random_picks(SQL_DEMO_POOL), SQL_DEMO_POOL))
def demo_test_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = sampling.DEMO_RANGE
    return sampling.stratified_test_set(targets(spark, sf_dir), "event_id", "value", low, high, SEED)


@query(
    "performance_test_set",
    sql_top_up(
        f"""(SELECT * FROM {sql_systematic_picks(SQL_HELD_OUT)} WHERE bin IN (1, 2, 9, 10)
             UNION ALL SELECT * FROM {sql_random_picks(SQL_HELD_OUT)} WHERE bin NOT IN (1, 2, 9, 10))""",
        SQL_HELD_OUT,
    ),
)
def performance_test_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.performance_test_set(targets(spark, sf_dir), "event_id", "value", SEED)


@query(
    "strata_counts",
    f"""
    WITH chosen AS ({SQL_REALISTIC}),
    edges AS (SELECT min(value) AS lo, max(value) AS hi FROM {SQL_REALISTIC_POOL})
    SELECT b AS bin, round(lo + (b - 1) * (hi - lo) / 10.0, 6) + 0.0 AS bin_low,
           round(lo + b * (hi - lo) / 10.0, 6) + 0.0 AS bin_high,
           (SELECT count(*) FROM chosen WHERE {sql_bin('value', 'lo', 'hi', 10)} = b) AS n
    FROM edges, (SELECT unnest(range(1, 11)) AS b)""",
)
def strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population of the chosen set in the strata of the pool; empty strata stay visible."""
    low, high = sampling.REALISTIC_RANGE
    chosen, edges = sampling.stratified_test_set_and_range(targets(spark, sf_dir), "event_id", "value", low, high, SEED)
    counts = stats.bin_population(chosen, "value", *edges, 10)
    return counts.withColumns({c: rounded(F.col(c)) for c in ("bin_low", "bin_high")})


@query(
    "stratified_sample",
    f"SELECT event_id, value, bin FROM {sql_random_picks('events')}",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = sampling.stratified_sample(targets(spark, sf_dir), "event_id", "value", 10, 10, SEED)
    return chosen.select("event_id", "value", "bin")


@query(
    "systematic_sample",
    f"SELECT event_id, value, bin FROM {sql_systematic_picks('events')}",
)
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = sampling.systematic_sample(targets(spark, sf_dir), "event_id", "value", 10, 10)
    return chosen.select("event_id", "value", "bin")


def sql_prefer(test: str, size: int) -> str:
    return f"""SELECT event_id, value, coalesce({test}, false) AS preferred FROM events
               ORDER BY coalesce({test}, false) DESC,
                        CASE WHEN {test} THEN '' ELSE {SQL_HASH} END, event_id LIMIT {size}"""


@query("prefer_then_fill", sql_prefer("value > 0.1", 50))
def prefer_then_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = sampling.prefer_then_fill(targets(spark, sf_dir), "event_id", F.col("value") > 0.1, 50, SEED)
    return chosen.select("event_id", "value", "preferred")


@query("prefer_then_fill_scarce", sql_prefer("value > 400", 50))
def prefer_then_fill_scarce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with few preferred rows, so that most are filled at random."""
    chosen = sampling.prefer_then_fill(targets(spark, sf_dir), "event_id", F.col("value") > 400, 50, SEED)
    return chosen.select("event_id", "value", "preferred")


@query("random_sample_n", f"SELECT event_id, value FROM events ORDER BY {SQL_HASH}, event_id LIMIT 50")
def random_sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_sample(targets(spark, sf_dir), "event_id", 50, SEED).select("event_id", "value")


@query(
    "train_test_split",
    f"SELECT event_id, value, CASE WHEN place <= {SQL_TEST_SIZE} THEN 'test' ELSE 'train' END AS split FROM {SQL_ORDERED}",
)
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sampling.train_test_split(targets(spark, sf_dir), "event_id", 0.2, SEED)
    return parts.select("event_id", "value", "split")


@query(
    "kfold_assign",
    f"SELECT event_id, value, CAST(ntile(5) OVER (ORDER BY {SQL_HASH}, event_id) AS BIGINT) AS fold FROM events",
)
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.assign_folds(targets(spark, sf_dir), "event_id", 5, SEED).select("event_id", "value", "fold")
