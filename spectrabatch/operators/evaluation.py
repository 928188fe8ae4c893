"""Prediction tables, error metrics, acceptance and comparison of models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import positions, rank_index

# Acceptance limits and limits of the leakage warnings.
R2_MIN = 0.7
RMSE_MAX = 2.0
MAE_MAX = 1.5
SUSPICIOUS_R2 = 0.99
SUSPICIOUS_CORRELATION = 0.95
IMPLAUSIBLE_PREDICTION = 1000.0


def error_columns(actual: str, predicted: str) -> dict[str, Column]:
    """Residual in both signs, absolute and percentage error (NULL where actual is 0)."""
    residual = F.col(predicted) - F.col(actual)
    return {
        "residual": residual,
        "residual_reversed": F.col(actual) - F.col(predicted),
        "abs_error": F.abs(residual),
        "error_pct": F.abs(F.try_divide(residual, F.col(actual)) * 100),
    }


def prediction_table(actual: DataFrame, predicted: DataFrame, key: str, y: str, y_hat: str) -> DataFrame:
    """Numbered table of actual, predicted and errors; the sides meet by sample key."""
    joined = actual.select(key, y).join(predicted.select(key, y_hat), key)
    index = rank_index.build(actual.select(key), key)
    return positions.with_position(joined, key, "sample", index).withColumns(error_columns(y, y_hat))


def metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """MSE, RMSE, MAE, R2 and MAPE as aggregates; R2 is NULL for a constant actual."""
    paired = predicted.isNotNull() & actual.isNotNull()
    y = F.when(paired, actual)
    error = predicted - actual
    mse = F.avg(error * error)
    return {
        "n": F.count(error),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg(F.abs(error)),
        "r2": 1 - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y)),
        "mape": F.avg(F.abs(F.try_divide(error, actual))) * 100,
    }


def regression_metrics(df: DataFrame, actual: str, models: Mapping[str, str], groups: Sequence[str] = ()) -> DataFrame:
    """One row per model (and group), all from one pass."""
    structs = []
    for i, (name, predicted) in enumerate(models.items()):
        parts = [m.alias(k) for k, m in metrics(F.col(actual), F.col(predicted)).items()]
        structs.append(F.struct(F.lit(name).alias("model"), *parts).alias(f"s{i}"))
    aggregated = df.groupBy(*groups).agg(*structs)
    return aggregated.select(*groups, F.inline(F.array(*[F.col(f"s{i}") for i in range(len(structs))])))


def metrics_by_split(df: DataFrame, actual: str, predicted: str, split: str, fold: str) -> DataFrame:
    """Rows r2, rmse, mae; columns train, test and the mean over the folds of the training part.

    Everything follows from one pass that keeps one row per split and fold: the
    sums of squares of the folds add up to those of their split.
    """
    error = F.col(predicted) - F.col(actual)
    parts = df.groupBy(split, fold).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(error * error).alias("sse"),
        F.sum(F.abs(error)).alias("sae"),
        F.avg(actual).alias("mean"),
        F.var_pop(actual).alias("var"),
    )
    whole = W.partitionBy(split)  # a handful of rows: one per split and fold
    center = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    parts = parts.withColumn("shift", F.col("mean") - center)
    spread = F.sum(F.col("n") * (F.col("var") + F.col("shift") * F.col("shift")))
    fold_r2 = F.avg(1 - F.try_divide(F.col("sse"), F.col("n") * F.col("var")))
    by_split = parts.groupBy(split).agg(
        (1 - F.try_divide(F.sum("sse"), spread)).alias("r2"),
        F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"),
        (F.sum("sae") / F.sum("n")).alias("mae"),
        fold_r2.alias("cv"),
    )
    none = F.lit(None).cast("double")
    rows = by_split.select(
        split,
        F.inline(
            F.array(
                F.struct(F.lit("r2").alias("metric"), F.col("r2").alias("value"), F.col("cv").alias("cv")),
                F.struct(F.lit("rmse").alias("metric"), F.col("rmse").alias("value"), none.alias("cv")),
                F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value"), none.alias("cv")),
            )
        ),
    )
    train, test = F.col(split) == "train", F.col(split) == "test"
    return rows.groupBy("metric").agg(
        F.max(F.when(train, F.col("value"))).alias("train"),
        F.max(F.when(test, F.col("value"))).alias("test"),
        F.max(F.when(train, F.col("cv"))).alias("cv_mean"),
    )


def acceptance_check(scores: DataFrame) -> DataFrame:
    """Adds Passed or Failed from r2, rmse and mae; a missing metric fails."""
    passed = (F.col("r2") > R2_MIN) & (F.col("rmse") < RMSE_MAX) & (F.col("mae") < MAE_MAX)
    return scores.withColumn("validation_result", F.when(passed, "Passed").otherwise("Failed"))


def model_ranking(scores: DataFrame) -> DataFrame:
    """Best model first by RMSE. The table has one row per model."""
    return scores.withColumn("rank", F.rank().over(W.partitionBy(F.lit(0)).orderBy("rmse")).cast("long")).orderBy(
        "rank", "model"
    )


def model_difference(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.withColumn("difference", F.abs(F.col(first) - F.col(second)))


def disagreement(df: DataFrame, first: str, second: str) -> DataFrame:
    gap = F.abs(F.col(first) - F.col(second))
    return df.agg(F.avg(gap).alias("mean_difference"), F.max(gap).alias("max_difference"))


def prediction_correlation(df: DataFrame, actual: str, first: str, second: str) -> DataFrame:
    return df.agg(
        F.corr(actual, first).alias("corr_first"),
        F.corr(actual, second).alias("corr_second"),
        F.corr(first, second).alias("corr_models"),
    )


def suspicion_flags(df: DataFrame, actual: str, first: str, second: str) -> DataFrame:
    """One row: both R2 suspiciously high, models suspiciously alike."""
    one, two = metrics(F.col(actual), F.col(first))["r2"], metrics(F.col(actual), F.col(second))["r2"]
    row = df.agg(one.alias("r2_first"), two.alias("r2_second"), F.corr(first, second).alias("corr_models"))
    high = (F.col("r2_first") > SUSPICIOUS_R2) & (F.col("r2_second") > SUSPICIOUS_R2)
    return row.withColumns(
        {"r2_suspicious": F.coalesce(high, F.lit(False)),
         "models_alike": F.coalesce(F.col("corr_models") > SUSPICIOUS_CORRELATION, F.lit(False))}
    )


def prediction_summary(df: DataFrame, models: Mapping[str, str]) -> DataFrame:
    """Mean, population deviation and maximum of each model's predictions."""
    from .statistics import per_column

    measures = {"mean": F.avg, "std": F.stddev_pop, "max": F.max}
    renamed = df.select(*[F.col(c).alias(n) for n, c in models.items()])
    return per_column(renamed, list(models), measures).withColumnRenamed("variable", "model")


def plausibility_gate(df: DataFrame, run: str, predicted: str) -> DataFrame:
    """One row per run: its largest raw prediction and whether the run is accepted."""
    largest = df.groupBy(run).agg(F.max(predicted).alias("max_prediction"))
    return largest.withColumn("accepted", F.coalesce(F.col("max_prediction") <= IMPLAUSIBLE_PREDICTION, F.lit(False)))


def run_history(df: DataFrame, run_time: Column, actual: str, models: Mapping[str, str]) -> DataFrame:
    """One row per run: time, number of spectra and RMSE of each model, oldest first."""
    rmse = [metrics(F.col(actual), F.col(p))["rmse"].alias(f"{name}_rmse") for name, p in models.items()]
    grouped = df.groupBy(run_time.alias("timestamp")).agg(F.count(F.lit(1)).alias("num_spectra"), *rmse)
    return grouped.orderBy("timestamp")
