"""Models, scoring and evaluation (survey section 2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.numeric import rounded
from ..functions.stencils import SpectralSteps
from ..operators import cleaning, evaluation, regression, sampling, scoring, spectral, wide_regression
from ..operators import statistics as stats
from ..session import scratch_dir
from ..sources import history, models, tables
from .base import (
    AXIS, POINTS, SQL_PREDICTIONS, SQL_SPECTRA, first_prediction, predictions, query, second_prediction, spectra, sql_round, targets,
)
from .sampling import SEED, SQL_HASH, SQL_TEST_SIZE
from .spectra import CUT, sql_chain, sql_scaled
from .statistics import rounded_columns, sql_closed_bin

MODELS = {"model_a": "pred_a", "model_b": "pred_b"}

# Coefficients from a rule, so that both engines can write them down.
RAW_MODEL = scoring.LinearModel("ElasticNet", tuple(((k * 7) % 11 - 5) * 10.0 for k in range(POINTS)), 30.0)
CHAIN_MODEL = scoring.LinearModel("ElasticNet", tuple(float((k * 5) % 13 - 6) for k in range(CUT)), 30.0)


def sql_metrics(y: str, p: str) -> str:
    e = f"({p} - {y})"
    return f"""count({e}) AS n, {sql_round(f'avg({e} * {e})')} AS mse, {sql_round(f'sqrt(avg({e} * {e}))')} AS rmse,
               {sql_round(f'avg(abs({e}))')} AS mae,
               {sql_round(f'1 - sum({e} * {e}) / (var_pop({y}) * count({y}))')} AS r2,
               {sql_round(f'avg(abs({e} / nullif({y}, 0))) * 100')} AS mape"""


SQL_SCORES = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS model, {sql_metrics('value', column)} FROM {SQL_PREDICTIONS}" for name, column in MODELS.items()
)


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluation.regression_metrics(predictions(spark, sf_dir), "value", MODELS)
    return rounded_columns(scores, "mse", "rmse", "mae", "r2", "mape")


def labelled_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled spectra with the batch label as numeric target."""
    scaled = spectral.standard_scale(spectra(spark, sf_dir), "spectrum")
    return scaled.select("vec_id", F.col("spectrum").alias("features"), F.col("label").cast("double").alias("target"))


@query(
    "linear_score",
    f"""SELECT vec_id,
          {sql_round('list_sum([s[i] * ((((i - 1) * 7) % 11) - 5) * 10.0 FOR i IN range(1, 65)]) + 30.0')} AS prediction
        FROM {SQL_SPECTRA}""",
)
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.linear_score(spectra(spark, sf_dir), "spectrum", RAW_MODEL)
    return scored.select("vec_id", rounded(F.col("prediction")).alias("prediction"))


@query(
    "score_models",
    f"""SELECT vec_id,
          {sql_round('list_sum([s[i] * ((((i - 1) * 7) % 11) - 5) * 10.0 FOR i IN range(1, 65)]) + 30.0')} AS elasticnet,
          CAST(NULL AS DOUBLE) AS pls
        FROM {SQL_SPECTRA}""",
)
def score_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models, of which the second one is not available."""
    scored = scoring.score_models(spectra(spark, sf_dir), "spectrum", {"elasticnet": RAW_MODEL, "pls": None})
    return scored.select("vec_id", rounded(F.col("elasticnet")).alias("elasticnet"), "pls")


SQL_DIRTY_CUT = f"""(SELECT vec_id, label, [CASE WHEN x > 0.4 THEN 0.0 ELSE x END FOR x IN s[6:52]] AS s
                     FROM {SQL_SPECTRA} WHERE label <> 7)"""
SQL_CHAIN_SCORE = f"""(SELECT vec_id, sum(z * (((i - 1) * 5) % 13 - 6)) + 30.0 AS score
                       FROM {sql_scaled(sql_chain(SQL_DIRTY_CUT), CUT)} GROUP BY vec_id)"""
SQL_BAND = """CASE WHEN {0} >= 0 AND {0} <= 40 THEN 'high' WHEN {0} > 40 AND {0} <= 60 THEN 'medium' ELSE 'low' END"""


@query(
    "batch_scoring",
    f"""SELECT vec_id, round_even(score, 2) + 0.0 AS predicted_concentration, 'ElasticNet' AS model_used,
              CASE WHEN label <> 7 THEN {SQL_BAND.format('score')} END AS confidence,
              CASE WHEN label = 7 THEN 'Spectrum ' || vec_id || ' has 60 values, expected 64' END AS reason
        FROM embeddings LEFT JOIN {SQL_CHAIN_SCORE} USING (vec_id)""",
)
def batch_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring service as a job: validate, clean, preprocess, score, round, band.

    Preprocessing and scaling are folded into the weights after one pass that
    fits the scaler; scoring is a dot product on the raw request.
    """
    gaps = F.transform("spectrum", lambda v: F.when(v > 0.4, F.lit(float("nan"))).otherwise(v))
    dirty = F.when(F.col("label") == 7, F.slice("spectrum", 1, 60)).otherwise(gaps)
    requests = spectra(spark, sf_dir).select("vec_id", dirty.alias("spectrum"))

    valid, _ = cleaning.split_valid(cleaning.validate_length(requests, "vec_id", "spectrum", POINTS))
    processed, _ = spectral.preprocess(valid, "spectrum", AXIS)
    scaler = spectral.fit_scaler(processed, "spectrum")
    model = scoring.fold_preprocessing(CHAIN_MODEL, AXIS, SpectralSteps(), scaler.means, scaler.divisors)
    return scoring.batch_scoring(requests, "vec_id", "spectrum", model)


@query(
    "confidence_band",
    f"SELECT event_id, {sql_round('pred_a')} AS prediction, {SQL_BAND.format('pred_a')} AS confidence FROM {SQL_PREDICTIONS}",
)
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = predictions(spark, sf_dir)
    return table.select(
        "event_id", rounded(F.col("pred_a")).alias("prediction"), numeric.confidence_band(F.col("pred_a")).alias("confidence")
    )


@query("regression_metrics", SQL_SCORES)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(spark, sf_dir)


@query(
    "acceptance_check",
    f"""SELECT model, r2, rmse, mae,
              CASE WHEN r2 > 0.7 AND rmse < 2.0 AND mae < 1.5 THEN 'Passed' ELSE 'Failed' END AS validation_result
        FROM ({SQL_SCORES})""",
)
def acceptance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = evaluation.acceptance_check(model_scores(spark, sf_dir))
    return checked.select("model", "r2", "rmse", "mae", "validation_result")


@query(
    "model_ranking",
    f"SELECT model, n, rmse, r2, rank() OVER (ORDER BY rmse) AS rank FROM ({SQL_SCORES})",
)
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.model_ranking(model_scores(spark, sf_dir)).select("model", "n", "rmse", "r2", "rank")


SQL_SPLIT = f"""(SELECT *, CASE WHEN split = 'train' THEN ntile(5) OVER (PARTITION BY split ORDER BY h, event_id) END AS fold
    FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY {SQL_HASH}, event_id) <= {SQL_TEST_SIZE}
                         THEN 'test' ELSE 'train' END AS split, {SQL_HASH} AS h FROM {SQL_PREDICTIONS}))"""


@query(
    "metrics_by_split",
    f"""
    WITH base AS (SELECT *, pred_a - value AS e FROM {SQL_SPLIT}),
    by_split AS (SELECT split, 1 - sum(e * e) / (var_pop(value) * count(*)) AS r2, sqrt(avg(e * e)) AS rmse,
                        avg(abs(e)) AS mae FROM base GROUP BY split),
    by_fold AS (SELECT fold, 1 - sum(e * e) / (var_pop(value) * count(*)) AS r2 FROM base WHERE fold IS NOT NULL GROUP BY fold),
    rows3 AS (SELECT split, unnest(['r2', 'rmse', 'mae']) AS metric, unnest([r2, rmse, mae]) AS v FROM by_split)
    SELECT metric, {sql_round("max(v) FILTER (split = 'train')")} AS train, {sql_round("max(v) FILTER (split = 'test')")} AS test,
           CASE WHEN metric = 'r2' THEN {sql_round('(SELECT avg(r2) FROM by_fold)')} END AS cv_mean
    FROM rows3 GROUP BY metric""",
)
def metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training, test and cross-validation metrics side by side."""
    parts = sampling.split_and_folds(predictions(spark, sf_dir), "event_id", 0.2, 5, SEED)
    result = evaluation.metrics_by_split(parts, "value", "pred_a", "split", "fold")
    return rounded_columns(result, "train", "test", "cv_mean")


@query(
    "prediction_table",
    f"""SELECT row_number() OVER (ORDER BY event_id) AS sample, event_id, value, {sql_round('pred_a')} AS pred_a,
              {sql_round('pred_a - value')} AS residual, {sql_round('value - pred_a')} AS residual_reversed,
              {sql_round('abs(pred_a - value)')} AS abs_error,
              {sql_round('abs((pred_a - value) / nullif(value, 0) * 100)')} AS error_pct
        FROM {SQL_PREDICTIONS}""",
)
def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = predictions(spark, sf_dir)
    result = evaluation.prediction_table(targets(spark, sf_dir), table, "event_id", "value", "pred_a")
    result = result.withColumn("sample", F.col("sample").cast("long"))
    return rounded_columns(result, "pred_a", "residual", "residual_reversed", "abs_error", "error_pct")


@query(
    "residual_histogram",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS variable, {sql_closed_bin(c, 'lo', 'hi', 15)} AS bin, count(*) AS n
            FROM (SELECT {e} AS {c} FROM {SQL_PREDICTIONS}),
                 (SELECT min({e}) AS lo, max({e}) AS hi FROM {SQL_PREDICTIONS}) GROUP BY ALL"""
        for c, e in {"residual_a": "value - pred_a", "residual_b": "value - pred_b", "pred_a": "pred_a", "pred_b": "pred_b"}.items()
    ),
)
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals and predictions of both models in 15 bins each."""
    table = predictions(spark, sf_dir).select(
        (F.col("value") - F.col("pred_a")).alias("residual_a"),
        (F.col("value") - F.col("pred_b")).alias("residual_b"),
        "pred_a",
        "pred_b",
    )
    return stats.multi_histogram(table, table.columns, 15)


@query(
    "prediction_summary",
    "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS model, {sql_round(f'avg({c})')} AS mean, {sql_round(f'stddev_pop({c})')} AS std,
              {sql_round(f'max({c})')} AS max FROM {SQL_PREDICTIONS}"""
        for name, c in MODELS.items()
    ),
)
def prediction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(evaluation.prediction_summary(predictions(spark, sf_dir), MODELS), "mean", "std", "max")


@query(
    "model_difference",
    f"SELECT event_id, {sql_round('pred_a')} AS pred_a, {sql_round('pred_b')} AS pred_b, {sql_round('abs(pred_a - pred_b)')} AS difference FROM {SQL_PREDICTIONS}",
)
def model_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = evaluation.model_difference(predictions(spark, sf_dir), "pred_a", "pred_b")
    return rounded_columns(table.select("event_id", "pred_a", "pred_b", "difference"), "pred_a", "pred_b", "difference")


@query(
    "model_disagreement",
    f"""SELECT {sql_round('avg(abs(pred_a - pred_b))')} AS mean_difference,
              {sql_round('max(abs(pred_a - pred_b))')} AS max_difference FROM {SQL_PREDICTIONS}""",
)
def model_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = evaluation.disagreement(predictions(spark, sf_dir), "pred_a", "pred_b")
    return rounded_columns(result, "mean_difference", "max_difference")


@query(
    "prediction_correlation",
    f"""SELECT {sql_round('corr(value, pred_a)')} AS corr_first, {sql_round('corr(value, pred_b)')} AS corr_second,
              {sql_round('corr(pred_a, pred_b)')} AS corr_models FROM {SQL_PREDICTIONS}""",
)
def prediction_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = evaluation.prediction_correlation(predictions(spark, sf_dir), "value", "pred_a", "pred_b")
    return rounded_columns(result, *result.columns)


@query(
    "prediction_range",
    f"""SELECT {sql_round('least(min(value), min(pred_a), min(pred_b))')} AS min_value,
              {sql_round('greatest(max(value), max(pred_a), max(pred_b))')} AS max_value FROM {SQL_PREDICTIONS}""",
)
def prediction_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = stats.series_range(predictions(spark, sf_dir), ["value", "pred_a", "pred_b"])
    return rounded_columns(result, "min_value", "max_value")


@query(
    "suspicion_flags",
    f"""SELECT *, r2_first > 0.99 AND r2_second > 0.99 AS r2_suspicious, corr_models > 0.95 AS models_alike
        FROM (SELECT {sql_round('1 - sum((pred_a - value) ^ 2) / (var_pop(value) * count(*))')} AS r2_first,
                     {sql_round('1 - sum((pred_b - value) ^ 2) / (var_pop(value) * count(*))')} AS r2_second,
                     {sql_round('corr(pred_a, pred_b)')} AS corr_models FROM {SQL_PREDICTIONS})""",
)
def suspicion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = evaluation.suspicion_flags(predictions(spark, sf_dir), "value", "pred_a", "pred_b")
    return rounded_columns(result, "r2_first", "r2_second", "corr_models")


@query(
    "sqrt_target",
    f"""SELECT event_id, {sql_round('sqrt(value)')} AS root, {sql_round('(sqrt(value) * 0.99 + 0.05) ^ 2')} AS prediction
        FROM events""",
)
def sqrt_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model on the root of the target; its output is squared."""
    root = F.sqrt("value")
    return targets(spark, sf_dir).select(
        "event_id", rounded(root).alias("root"), rounded(F.pow(root * 0.99 + 0.05, F.lit(2.0))).alias("prediction")
    )


@query(
    "history_rmse",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS timestamp, count(*) AS num_spectra,
              {sql_round('sqrt(avg((pred_a - value) ^ 2))')} AS elasticnet_rmse,
              {sql_round('sqrt(avg((pred_b - value) ^ 2))')} AS pls_rmse
        FROM events JOIN (SELECT event_id, pred_a, pred_b FROM {SQL_PREDICTIONS}) USING (event_id) GROUP BY 1""",
)
def history_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scoring run per day: its size and the error of both models against the actual values."""
    from ..sources.tables import read_parquet
    from .base import first_prediction, second_prediction

    events = read_parquet(spark, sf_dir, "events")
    scored = events.withColumns({"pred_a": first_prediction(), "pred_b": second_prediction()})
    day = F.date_format("ts", "yyyy-MM-dd")
    history = evaluation.run_history(scored, day, "value", {"elasticnet": "pred_a", "pls": "pred_b"})
    return rounded_columns(history, "elasticnet_rmse", "pls_rmse")


@query(
    "plausibility_gate",
    f"""SELECT user_id, {sql_round('max(pred_a * 3)')} AS max_prediction, max(pred_a * 3) <= 1000 AS accepted
        FROM {SQL_PREDICTIONS} GROUP BY user_id""",
)
def plausibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = predictions(spark, sf_dir).withColumn("raw", F.col("pred_a") * 3)
    return rounded_columns(evaluation.plausibility_gate(raw, "user_id", "raw"), "max_prediction")


SQL_LABELLED = f"(SELECT vec_id, i, z, label::DOUBLE AS y FROM {sql_scaled(SQL_SPECTRA, POINTS)})"


@query(
    "gram_matrix",
    f"""
    WITH f AS MATERIALIZED (
        SELECT vec_id, CAST(i AS BIGINT) AS i, z FROM {SQL_LABELLED}
        UNION ALL SELECT vec_id, 0, 1.0 FROM embeddings
        UNION ALL SELECT vec_id, {POINTS + 1}, label::DOUBLE FROM embeddings)
    SELECT a.i AS i, b.i AS j, {sql_round('sum(a.z * b.z)')} AS value FROM f a JOIN f b USING (vec_id) GROUP BY 1, 2""",
)
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_columns(regression.gram_matrix(labelled_spectra(spark, sf_dir), "features", "target"), "value")


@query(
    "pls_first_component",
    f"""
    WITH f AS MATERIALIZED (
        SELECT vec_id, i, v, y, v - avg(v) OVER p AS x, stddev_samp(v) OVER p AS sx,
               (y - avg(y) OVER p) AS yc
        FROM (SELECT vec_id, label::DOUBLE AS y, unnest(range(1, {POINTS + 1})) AS i, unnest(s) AS v FROM {SQL_SPECTRA})
        WINDOW p AS (PARTITION BY i)),
    w AS MATERIALIZED (SELECT i, sum(x / sx * yc) AS w, max(sx) AS sx FROM f GROUP BY i),
    t AS MATERIALIZED (SELECT vec_id, sum(x / f.sx * w) AS t, max(yc) AS yc FROM f JOIN w USING (i) GROUP BY vec_id),
    q AS (SELECT sum(t * yc) / sum(t * t) AS q FROM t)
    SELECT CAST(i - 1 AS BIGINT) AS pos, {sql_round('w * q / sx')} AS coefficient FROM w, q""",
)
def pls_first_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLS with one latent variable, which has a closed form."""
    table = spectra(spark, sf_dir).select("spectrum", F.col("label").cast("double").alias("target"))
    return coefficient_table(spark, regression.fit_pls(table, "spectrum", "target", 1)).where("pos >= 0")


def coefficient_table(spark: SparkSession, model: scoring.LinearModel) -> DataFrame:
    """Coefficients by position; the intercept has position -1."""
    rows = [(-1, float(model.intercept))] + list(enumerate(model.coefficients))
    return rounded_columns(spark.createDataFrame(rows, "pos long, coefficient double"), "coefficient")


@query("elasticnet_fit")
def elasticnet_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = regression.fit_elasticnet(labelled_spectra(spark, sf_dir), "features", "target", 0.1, 0.5)
    return coefficient_table(spark, regression.as_linear_model(fitted))


@query("pls_fit")
def pls_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coefficient_table(spark, regression.fit_pls(labelled_spectra(spark, sf_dir), "features", "target", 10))


@query("cv_metrics")
def cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-fold R2 of PLS sizes and ElasticNet penalties, all from one pass."""
    folded = sampling.assign_folds(labelled_spectra(spark, sf_dir), "vec_id", 5, SEED)
    scores = regression.cross_validate(
        folded, "features", "target", "fold", [1, 2, 5, 10, 20], [(0.01, 0.5), (0.1, 0.5), (1.0, 0.5), (0.1, 1.0)]
    )
    return rounded_columns(regression.cv_summary(scores), "cv_mean", "cv_std", "cv_min", "cv_max")


@query(
    "cv_first_component",
    f"""
    WITH folded AS (SELECT vec_id, ntile(5) OVER (ORDER BY md5(vec_id || ':{SEED}'), vec_id) AS fold FROM embeddings),
    f AS MATERIALIZED (
        SELECT h AS held, vec_id, fold = h AS test, i, v, y
        FROM (SELECT vec_id, label::DOUBLE AS y, unnest(range(1, {POINTS + 1})) AS i, unnest(s) AS v FROM {SQL_SPECTRA})
        JOIN folded USING (vec_id), (SELECT unnest(range(1, 6)) AS h)),
    m AS MATERIALIZED (
        SELECT held, i, avg(v) AS mx, stddev_samp(v) AS sx, avg(y) AS my FROM f WHERE NOT test GROUP BY held, i),
    w AS MATERIALIZED (
        SELECT held, i, mx, sx, my, sum((v - mx) / sx * (y - my)) AS w
        FROM f JOIN m USING (held, i) WHERE NOT test GROUP BY held, i, mx, sx, my),
    t AS MATERIALIZED (
        SELECT held, vec_id, test, y, my, sum((v - mx) / sx * w) AS t
        FROM f JOIN w USING (held, i) GROUP BY held, vec_id, test, y, my),
    q AS (SELECT held, sum(t * (y - my)) / sum(t * t) AS q FROM t WHERE NOT test GROUP BY held)
    SELECT 'PLS(1)' AS model, held AS fold,
           {sql_round('1 - sum((y - my - t * q) ^ 2) / (var_pop(y) * count(*))')} AS r2
    FROM t JOIN q USING (held) WHERE test GROUP BY held""",
)
def cv_first_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 of each fold for one latent variable, which SQL can follow."""
    table = spectra(spark, sf_dir).select("vec_id", "spectrum", F.col("label").cast("double").alias("target"))
    folded = sampling.assign_folds(table, "vec_id", 5, SEED)
    return rounded_columns(regression.cross_validate(folded, "spectrum", "target", "fold", components=[1]), "r2")


SQL_TRAINING_STATS = f"""(SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS d
    FROM (SELECT vec_id, unnest(range(1, {CUT} + 1)) AS i, unnest(s) AS v FROM {sql_chain(SQL_DIRTY_CUT)}) WHERE vec_id % 5 > 0 GROUP BY i)"""
SQL_STORED_SCORE = f"""(SELECT vec_id, sum((v - m) / d * (((i - 1) * 5) % 13 - 6)) + 30.0 AS score
    FROM (SELECT vec_id, unnest(range(1, {CUT} + 1)) AS i, unnest(s) AS v FROM {sql_chain(SQL_DIRTY_CUT)}) JOIN {SQL_TRAINING_STATS} USING (i)
    WHERE vec_id % 5 = 0 GROUP BY vec_id)"""


@query(
    "batch_scoring_stored",
    f"""SELECT vec_id, round_even(score, 2) + 0.0 AS predicted_concentration, 'ElasticNet' AS model_used,
              CASE WHEN label <> 7 THEN {SQL_BAND.format('score')} END AS confidence,
              CASE WHEN label = 7 THEN 'Spectrum ' || vec_id || ' has 60 values, expected 64' END AS reason
        FROM embeddings LEFT JOIN {SQL_STORED_SCORE} USING (vec_id) WHERE vec_id % 5 = 0""",
)
def batch_scoring_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit scaler on training rows, store it beside the model, load both, score the other rows."""
    gaps = F.transform("spectrum", lambda v: F.when(v > 0.4, F.lit(float("nan"))).otherwise(v))
    dirty = F.when(F.col("label") == 7, F.slice("spectrum", 1, 60)).otherwise(gaps)
    samples = spectra(spark, sf_dir).select("vec_id", dirty.alias("spectrum"))

    training, _ = cleaning.split_valid(cleaning.validate_length(samples.where("vec_id % 5 > 0"), "vec_id", "spectrum", POINTS))
    processed, _ = spectral.preprocess(training, "spectrum", AXIS)
    folder = scratch_dir(spark, "models")
    models.save_scaler(spark, spectral.fit_scaler(processed, "spectrum"), f"{folder}/scaler")
    models.save_linear(spark, CHAIN_MODEL, f"{folder}/model")

    scaler, fitted = models.load_scaler(spark, f"{folder}/scaler"), models.load_linear(spark, f"{folder}/model")
    model = scoring.fold_preprocessing(fitted, AXIS, SpectralSteps(), scaler.means, scaler.divisors)
    return scoring.batch_scoring(samples.where("vec_id % 5 = 0"), "vec_id", "spectrum", model)


@query(
    "requests_scored",
    f"""SELECT 'ElasticNet' AS model_used, count(*) FILTER (label <> 7) AS total_spectra, count(*) FILTER (label = 7) AS rejected FROM embeddings""",
)
def requests_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies as JSON lines in a shared folder, read, scored and summed up."""
    values = F.when(F.col("label") == 7, F.slice("spectrum", 1, 60)).otherwise(F.col("spectrum"))
    folder = scratch_dir(spark, "requests")
    spectra(spark, sf_dir).select(F.col("vec_id").alias("request_id"), values.alias("spectral_values")).write.json(folder)
    scored = scoring.batch_scoring(tables.read_requests(spark, folder), "request_id", "spectrum", RAW_MODEL)
    return scoring.scoring_summary(scored)


@query(
    "prediction_export",
    f"""SELECT event_id, value, {sql_round('pred_a')} AS pred_a, {sql_round('pred_a - value')} AS residual,
              {sql_round('abs((pred_a - value) / nullif(value, 0) * 100)')} AS error_pct FROM {SQL_PREDICTIONS}""",
)
def prediction_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction table as CSV in a shared folder, read back."""
    table = predictions(spark, sf_dir).withColumns(evaluation.error_columns("value", "pred_a"))
    exported = rounded_columns(table.select("event_id", "value", "pred_a", "residual", "error_pct"), "pred_a", "residual", "error_pct")
    folder = scratch_dir(spark, "export")
    tables.write_csv(exported, folder)
    return tables.read_csv(spark, folder, exported.schema)


@query(
    "history_runs",
    f"""SELECT strftime(ts, '%Y-%m-%d') || ' 00:00:00' AS timestamp, count(*) AS num_spectra,
              {sql_round('sqrt(avg((pred_a - value) ^ 2))')} AS elasticnet_rmse, {sql_round('sqrt(avg((pred_b - value) ^ 2))')} AS pls_rmse
        FROM events JOIN (SELECT event_id, pred_a, pred_b FROM {SQL_PREDICTIONS}) USING (event_id) GROUP BY 1""",
)
def history_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs appended to the stored history in two parts, after what was there has been cleared."""
    events = tables.read_parquet(spark, sf_dir, "events").withColumns({"pred_a": first_prediction(), "pred_b": second_prediction()})
    runs = evaluation.run_history(events, F.to_timestamp(F.date_trunc("day", "ts")), "value", {"elasticnet": "pred_a", "pls": "pred_b"})
    runs = runs.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    path = scratch_dir(spark, "history")
    history.append(runs, path)
    history.clear(spark, path)
    early = F.dayofmonth("timestamp") <= 15
    history.append(runs.where(early), path)
    history.append(runs.where(~early), path)
    shown = history.read(spark, path).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    return rounded_columns(shown, "elasticnet_rmse", "pls_rmse")


SQL_ONE = """(SELECT covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)"""


@query(
    "elasticnet_one_feature",
    f"""SELECT {sql_round('w', 4)} AS coefficient, {sql_round('my - w * mx', 3)} AS intercept
        FROM (SELECT *, sign(c) * greatest(abs(c) - 20.0 * 0.5, 0) / (v + 20.0 * 0.5) AS w FROM {SQL_ONE})""",
)
def elasticnet_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one feature the fit is a soft threshold."""
    rows = tables.read_parquet(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    model = regression.fit_elasticnet_moments(rows, "x", "y", 20.0, 0.5)
    return spark.createDataFrame([(model.coefficients[0], model.intercept)], "w double, b double").select(
        rounded(F.col("w"), 4).alias("coefficient"), rounded(F.col("b"), 3).alias("intercept")
    )


@query(
    "pls_two_features",
    f"""SELECT {sql_round('(c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12)', 4)} AS first,
              {sql_round('(c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12)', 2)} AS second
        FROM (SELECT covar_pop(l_extendedprice, l_quantity) AS c1, covar_pop(l_extendedprice, l_discount) AS c2, var_pop(l_quantity) AS v1,
                     var_pop(l_discount) AS v2, covar_pop(l_quantity, l_discount) AS v12 FROM lineitem)""",
)
def pls_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many components as features: least squares."""
    rows = tables.read_parquet(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_discount").alias("x"), F.col("l_extendedprice").alias("y"))
    first, second = regression.fit_pls(rows, "x", "y", 2).coefficients
    return spark.createDataFrame([(first, second)], "a double, b double").select(rounded(F.col("a"), 4).alias("first"), rounded(F.col("b"), 2).alias("second"))


@query(
    "cv_one_feature",
    f"""
    WITH folded AS (SELECT value AS y, user_id::DOUBLE AS x, ntile(5) OVER (ORDER BY {SQL_HASH}, event_id) AS fold FROM events),
    fits AS (SELECT h, sign(c) * greatest(abs(c) - 0.05, 0) / (v + 0.05) AS w, mx, my
             FROM (SELECT h, covar_pop(y, x) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my
                   FROM folded, (SELECT unnest(range(1, 6)) AS h) WHERE fold <> h GROUP BY h))
    SELECT h AS fold, {sql_round('1 - sum((y - my - w * (x - mx)) ^ 2) / (var_pop(y) * count(*))')} AS r2
    FROM folded JOIN fits ON fold = h GROUP BY h""",
)
def cv_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-fold R2 of a penalised fit on one feature."""
    rows = tables.read_parquet(spark, sf_dir, "events").select("event_id", F.array(F.col("user_id").cast("double")).alias("x"), F.col("value").alias("y"))
    folded = sampling.assign_folds(rows, "event_id", 5, SEED)
    scores = regression.cross_validate(folded, "x", "y", "fold", penalties=[(0.1, 0.5)])
    return scores.select("fold", rounded(F.col("r2")).alias("r2"))


@query(
    "pls_wide_two_components",
    f"""
    WITH f AS MATERIALIZED (
        SELECT vec_id, i, (v - avg(v) OVER p) / stddev_samp(v) OVER p AS x, (y - avg(y) OVER p) / stddev_samp(y) OVER p AS y
        FROM (SELECT vec_id, label::DOUBLE AS y, unnest(range(1, {POINTS + 1})) AS i, unnest(s) AS v FROM {SQL_SPECTRA})
        WINDOW p AS (PARTITION BY i)),
    w1 AS MATERIALIZED (SELECT i, sum(x * y) AS w FROM f GROUP BY i),
    t1 AS MATERIALIZED (SELECT vec_id, sum(x * w) AS t, max(y) AS y FROM f JOIN w1 USING (i) GROUP BY vec_id),
    q1 AS MATERIALIZED (SELECT sum(t * y) / sum(t * t) AS q, sum(t * t) AS tt FROM t1),
    p1 AS MATERIALIZED (SELECT i, sum(x * t) / max(tt) AS p FROM f JOIN t1 USING (vec_id), q1 GROUP BY i),
    g AS MATERIALIZED (
        SELECT vec_id, i, x - t * p AS x, f.y - t * q AS y FROM f JOIN t1 USING (vec_id) JOIN p1 USING (i), q1),
    w2 AS MATERIALIZED (SELECT i, sum(x * y) AS w FROM g GROUP BY i),
    t2 AS MATERIALIZED (SELECT vec_id, sum(x * w) AS t, max(y) AS y FROM g JOIN w2 USING (i) GROUP BY vec_id),
    q2 AS (SELECT sum(t * y) / sum(t * t) AS q FROM t2),
    l AS (SELECT avg(label) AS my, stddev_samp(label) AS sy FROM embeddings)
    SELECT vec_id, {sql_round('my + sy * (t1.t * q1.q + t2.t * q2.q)')} AS predicted
    FROM t1 JOIN t2 USING (vec_id), q1, q2, l""",
)
def pls_wide_two_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the fit that holds no matrix of all features."""
    table = spectra(spark, sf_dir).select("vec_id", "spectrum", F.col("label").cast("double").alias("target"))
    model = wide_regression.fit_pls(table, "spectrum", "target", 2)
    return scoring.linear_score(table, "spectrum", model).select("vec_id", rounded(F.col("prediction")).alias("predicted"))


@query(
    "elasticnet_wide_one_feature",
    f"""SELECT {sql_round('w', 4)} AS coefficient, {sql_round('my - w * mx', 3)} AS intercept
        FROM (SELECT *, sign(c) * greatest(abs(c) - 20.0 * 0.5, 0) / (v + 20.0 * 0.5) AS w FROM {SQL_ONE})""",
)
def elasticnet_wide_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read_parquet(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    model = wide_regression.fit_elasticnet(rows, "x", "y", 20.0, 0.5)
    return spark.createDataFrame([(model.coefficients[0], model.intercept)], "w double, b double").select(
        rounded(F.col("w"), 4).alias("coefficient"), rounded(F.col("b"), 3).alias("intercept")
    )
