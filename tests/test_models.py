"""Fits against closed forms, evaluation edge cases, persistence, registry, stream."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from spectrabatch.operators import evaluation, registry, regression, scoring, spectral
from spectrabatch.sources import history, models, registry_store, tables
from spectrabatch.streaming import scoring as stream

SIZE, WIDTH = 120, 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(SIZE, WIDTH)) * np.arange(1, WIDTH + 1) + 10
    y = x @ np.array([1.0, -2.0, 0.0, 0.5, 0.0, 0.1]) + rng.normal(size=SIZE) + 4
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    rows = [(i, [float(v) for v in x[i]], float(y[i]), i % 5) for i in range(SIZE)]
    return spark.createDataFrame(rows, "id long, x array<double>, y double, fold long").repartition(6)


def scaled(x):
    return (x - x.mean(0)) / x.std(0)


def test_cross_products(frame, data):
    x, y = data
    full = np.column_stack([np.ones(SIZE), x, y])
    parts = regression.products_by_fold(frame, "x", "y", "fold")
    np.testing.assert_allclose(sum(parts.values()), full.T @ full, rtol=1e-12)
    np.testing.assert_allclose(parts[2], full[2::5].T @ full[2::5], rtol=1e-12)


def test_pls_with_all_components_is_least_squares(frame, data):
    x, y = data
    model = regression.fit_pls(frame, "x", "y", WIDTH)
    exact, *_ = np.linalg.lstsq(np.column_stack([np.ones(SIZE), x]), y, rcond=None)
    np.testing.assert_allclose([model.intercept, *model.coefficients], exact, rtol=1e-8)


def test_pls_matches_deflation_of_the_data(frame, data):
    """Three components against the classic algorithm that deflates the data matrix itself."""
    x, y = data
    z, t = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    e, f, w, p, q = z.copy(), t.copy(), [], [], []
    for _ in range(3):
        weight = e.T @ f
        weight /= np.linalg.norm(weight)
        score = e @ weight
        load, gain = e.T @ score / (score @ score), f @ score / (score @ score)
        e, f = e - np.outer(score, load), f - gain * score
        w.append(weight), p.append(load), q.append(gain)
    w, p = np.array(w).T, np.array(p).T
    expected = w @ np.linalg.solve(p.T @ w, np.array(q)) * y.std(ddof=1) / x.std(0, ddof=1)
    np.testing.assert_allclose(regression.fit_pls(frame, "x", "y", 3).coefficients, expected, rtol=1e-8)


def test_pls_survives_constant_columns_and_target(spark):
    df = spark.createDataFrame([([1.0, float(i)], 2.0 * i) for i in range(10)], "x array<double>, y double")
    model = regression.fit_pls(df, "x", "y", 2)
    np.testing.assert_allclose(model.coefficients, [0.0, 2.0], atol=1e-9)
    flat = regression.fit_pls(df.withColumn("y", F.lit(3.0)), "x", "y", 2)
    assert flat.intercept == pytest.approx(3.0) and max(map(abs, flat.coefficients)) < 1e-9


@pytest.mark.parametrize("alpha,ratio", [(0.1, 0.5), (1.0, 0.9), (0.5, 0.0), (0.0, 0.5)])
def test_elasticnet_meets_its_optimality_conditions(spark, data, alpha, ratio):
    x, y = data
    z = scaled(x)
    df = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(z, y)], "x array<double>, y double")
    model = regression.as_linear_model(regression.fit_elasticnet(df, "x", "y", alpha, ratio))
    w = np.array(model.coefficients)
    gradient = z.T @ (y - z @ w - model.intercept) / SIZE - alpha * (1 - ratio) * w
    active = np.abs(w) > 1e-9
    np.testing.assert_allclose(gradient[active], alpha * ratio * np.sign(w[active]), atol=1e-5)
    assert (np.abs(gradient[~active]) <= alpha * ratio + 1e-5).all()
    again, intercept = regression.elasticnet_coefficients(regression.products_by_fold(df, "x", "y")[0], alpha, ratio)
    np.testing.assert_allclose(again, w, atol=1e-5)
    assert intercept == pytest.approx(model.intercept, abs=1e-5)


def test_cross_validation_equals_refitting(frame, data):
    x, y = data
    scores = regression.cross_validate(frame, "x", "y", "fold", [2, WIDTH], [(0.1, 0.5)])
    got = {(r["model"], r["fold"]): r["r2"] for r in scores.collect()}
    for f in range(5):
        held = np.arange(SIZE) % 5 == f
        fit, *_ = np.linalg.lstsq(np.column_stack([np.ones((~held).sum()), x[~held]]), y[~held], rcond=None)
        error = y[held] - np.column_stack([np.ones(held.sum()), x[held]]) @ fit
        expected = 1 - (error @ error) / ((y[held] - y[held].mean()) ** 2).sum()
        assert got[f"PLS({WIDTH})", f] == pytest.approx(expected, rel=1e-8)
    summary = {r["model"]: r for r in regression.cv_summary(scores).collect()}
    values = [v for (m, _), v in got.items() if m == "PLS(2)"]
    assert summary["PLS(2)"]["cv_std"] == pytest.approx(np.std(values))
    assert summary["PLS(2)"]["cv_min"] == min(values) and summary["PLS(2)"]["folds"] == 5


def test_scaling_inside_the_folds(spark, frame, data):
    x, y = data
    inside = regression.cross_validate(frame, "x", "y", "fold", penalties=[(0.3, 0.5)], scale_in_fold=True)
    got = {r["fold"]: r["r2"] for r in inside.collect()}
    for f in range(5):
        held = np.arange(SIZE) % 5 == f
        mean, deviation = x[~held].mean(0), x[~held].std(0)
        part = np.column_stack([np.ones((~held).sum()), (x[~held] - mean) / deviation, y[~held]])
        w, b = regression.elasticnet_coefficients(part.T @ part, 0.3, 0.5)
        error = y[held] - (x[held] - mean) / deviation @ w - b
        assert got[f] == pytest.approx(1 - (error @ error) / ((y[held] - y[held].mean()) ** 2).sum(), rel=1e-8)


def test_bad_features_are_refused(spark, monkeypatch):
    """Other lengths, gaps and too many columns raise instead of giving a wrong matrix."""
    make = lambda rows: spark.createDataFrame([(x, 1.0 * i, i % 2) for i, x in enumerate(rows)], "x array<double>, y double, fold long").coalesce(1)
    for rows in ([[1.0, 2.0, 3.0], [1.0]], [[1.0, None], [2.0, 3.0]], [[1.0, float("nan")], [2.0, 3.0]]):
        with pytest.raises(ValueError):
            regression.fit_pls(make(rows), "x", "y", 1)
        with pytest.raises(ValueError):
            regression.cross_validate(make(rows), "x", "y", "fold", [1])
    for rows in ([[1.0, 2.0, 3.0], [1.0]], [[1.0, None], [2.0, 3.0]]):
        with pytest.raises(Exception, match="feature array"):
            regression.gram_matrix(make(rows), "x", "y").collect()
    monkeypatch.setattr(regression, "MAX_FEATURES", 1)
    with pytest.raises(ValueError, match="more than 1 features"):
        regression.fit_pls(make([[1.0, 2.0], [2.0, 5.0]]), "x", "y", 1)


def test_unfinished_fits_are_reported(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=200)
    x = np.column_stack([base + 1e-4 * rng.normal(size=200) for _ in range(5)])
    full = np.column_stack([np.ones(200), x, x.sum(axis=1)])
    with pytest.raises(regression.NotConverged):
        regression.elasticnet_coefficients(full.T @ full, 1e-7, 0.5, sweeps=50)


def test_centred_products_keep_small_variances(spark):
    """Mean 1e6 and deviation 1e-2: sums of squares would cancel."""
    rng = np.random.default_rng(5)
    x = 1e6 + 1e-2 * rng.normal(size=(400, 3))
    y = (x - 1e6) @ np.array([1.0, -2.0, 0.5])
    df = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(5)
    np.testing.assert_allclose(regression.fit_pls(df, "x", "y", 3).coefficients, [1.0, -2.0, 0.5], rtol=1e-5)


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.5), (None, 9.0), (4.0, None)], "y double, p double")
    row = evaluation.regression_metrics(df, "y", {"m": "p"}).first()
    assert row["n"] == 2 and row["mape"] == pytest.approx(25.0) and row["r2"] == pytest.approx(1 - 1.25 / 2)
    constant = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, p double")
    scores = evaluation.regression_metrics(constant, "y", {"m": "p"})
    assert scores.first()["r2"] is None
    assert evaluation.acceptance_check(scores).first()["validation_result"] == "Failed"
    table = df.withColumns(evaluation.error_columns("y", "p")).orderBy("p").collect()
    zero = [r for r in table if r["y"] == 0.0][0]
    assert zero["error_pct"] is None and zero["residual"] == 1.0 and zero["residual_reversed"] == -1.0


def test_acceptance_limits_are_strict(spark):
    df = spark.createDataFrame([(0.71, 1.99, 1.49), (0.7, 1.0, 1.0), (0.9, 2.0, 1.0), (0.9, 1.0, 1.5)], "r2 double, rmse double, mae double")
    assert [r[0] for r in evaluation.acceptance_check(df).select("validation_result").collect()] == ["Passed"] + ["Failed"] * 3


def test_model_persistence(spark, frame, tmp_path):
    model = regression.fit_pls(frame, "x", "y", 2)
    path = models.stamped_path(str(tmp_path), "PLS Regression", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("/pls_regression_20240102_030405")
    models.save_linear(spark, model, path)
    assert models.load_linear(spark, path) == model
    assert models.load_optional(spark, str(tmp_path / "absent")) is None
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], models.SCHEMA).write.parquet(empty)
    with pytest.raises(models.NotFittedError):
        models.load_linear(spark, empty)


def test_pipeline_persistence(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)], "a double, y double")
    fitted = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="v"), LinearRegression(featuresCol="v", labelCol="y")]).fit(df)
    models.save_pipeline(fitted, str(tmp_path / "p"))
    loaded = models.load_pipeline(str(tmp_path / "p"))
    assert loaded.transform(df).where("abs(prediction - y) > 1e-6").count() == 0


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    run = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS timestamp, 3L AS num_spectra, 0.5D AS elasticnet_rmse, CAST(NULL AS DOUBLE) AS pls_rmse")
    history.append(run, path)
    history.append(run, path)
    assert history.read(spark, path).count() == 2
    history.clear(spark, path)
    assert history.read(spark, path).count() == 0
    history.append(run, path)
    assert history.read(spark, path).count() == 1


def test_sample_csv_and_requests(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 'a "quoted", text', 2.0), (None, None, 3.0)], "`Time (h)` double, note string, `200.5` double")
    path = str(tmp_path / "csv")
    tables.write_csv(df, path)
    back = tables.read_samples_csv(spark, path, ["note"])
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    facts = tables.file_facts(back).collect()
    assert facts and all(r["file_size"] > 0 and r["file_modification_time"] for r in facts)
    requests = tables.requests_table(spark, [[0.0, 1.0], [2, None]])
    assert [r["spectrum"] for r in requests.orderBy("request_id").collect()] == [[0.0, 1.0], [2.0, None]]
    (tmp_path / "r.json").write_text('{"request_id": 7, "spectral_values": [1, 2.5]}\n')
    assert tables.read_requests(spark, str(tmp_path / "r.json")).first()["spectrum"] == [1.0, 2.5]
    tables.write_packed(df, str(tmp_path / "packed"), "Time (h)")
    assert spark.read.parquet(str(tmp_path / "packed")).count() == 2


def submission(spark, rows):
    return spark.createDataFrame(rows, "submission long, model_name string, r2 double, rmse double, mae double").select(
        "submission", "model_name", F.lit("Hybrid").alias("model_type"), F.lit("d").alias("description"),
        F.lit("me").alias("created_by"), F.lit("f").alias("file_path"), F.lit("h").alias("file_hash"),
        F.struct(F.col("r2").alias("r2_score"), "rmse", "mae").alias("performance_metrics"),
        F.struct(F.lit(3).alias("layers")).alias("parameters"), F.struct(F.lit(4000).alias("training_samples")).alias("data_info"),
    )


def test_registry_inserts_once(spark, tmp_path):
    store = registry_store.Registry(spark, str(tmp_path / "registry"))
    first = submission(spark, [(5, "PLS", 0.9, 1.0, 0.8), (9, "Weak", 0.5, 1.0, 0.8)])
    assert store.register(first) == 2 and store.register(first) == 0
    more = submission(spark, [(1, "PLS", 0.9, 1.0, 0.8), (2, "Hybrid", 0.8, 1.9, 1.0)])
    assert store.register(more) == 1
    assert [(r["model_id"], r["model_name"]) for r in store.table("models").orderBy("model_id").collect()] == [
        (1, "PLS"), (2, "Weak"), (3, "Hybrid"),
    ]
    store.register_views()
    joined = spark.sql(
        """SELECT m.model_name, v.version_id, v.performance_metrics, c.validation_result, d.environment
           FROM models m JOIN model_versions v ON m.model_id = v.model_id
           JOIN model_validations c ON c.version_id = v.version_id
           LEFT JOIN model_deployments d ON d.version_id = v.version_id ORDER BY m.model_id"""
    ).collect()
    assert [(r["model_name"], r["version_id"], r["validation_result"], r["environment"]) for r in joined] == [
        ("PLS", 1, "Passed", "Production"), ("Weak", 2, "Failed", None), ("Hybrid", 3, "Passed", "Production"),
    ]
    assert json.loads(joined[0]["performance_metrics"]) == {"r2_score": 0.9, "rmse": 1.0, "mae": 0.8}


def test_repeated_and_missing_names_are_inserted_once(spark, tmp_path):
    store = registry_store.Registry(spark, str(tmp_path / "registry"))
    rows = [(7, "B", 0.9, 1.0, 0.8), (3, "B", 0.1, 1.0, 0.8), (4, None, 0.9, 1.0, 0.8), (5, "C", 0.9, 1.0, 0.8), (6, "C", 0.9, 1.0, 0.8)]
    assert store.register(submission(spark, rows)) == 2
    assert [(r["model_id"], r["model_name"]) for r in store.table("models").orderBy("model_id").collect()] == [(1, "B"), (2, "C")]
    assert store.table("model_validations").where("version_id = 1").first()["validation_result"] == "Failed"  # the first submission counts


def test_only_a_missing_path_is_an_empty_table(spark, tmp_path):
    assert registry_store.Registry(spark, str(tmp_path / "absent")).table("models").count() == 0
    (tmp_path / "broken" / "models").mkdir(parents=True)
    (tmp_path / "broken" / "models" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        registry_store.Registry(spark, str(tmp_path / "broken")).table("models").collect()


def test_scaler_persistence(spark, tmp_path):
    scaler = spectral.Scaler((1.5, -2.0, 0.0), (1.0, 3.0, 0.25))
    models.save_scaler(spark, scaler, str(tmp_path / "scaler"))
    assert models.load_scaler(spark, str(tmp_path / "scaler")) == scaler
    spark.createDataFrame([(1, 0.0, 1.0)], models.SCALER_SCHEMA).write.parquet(str(tmp_path / "part"))
    with pytest.raises(models.NotFittedError):
        models.load_scaler(spark, str(tmp_path / "part"))


def test_moment_fit_equals_the_library_fit(spark, data):
    x, y = data
    df = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(scaled(x), y)], "x array<double>, y double")
    one, two = regression.fit_elasticnet_moments(df, "x", "y", 0.3, 0.7), regression.as_linear_model(regression.fit_elasticnet(df, "x", "y", 0.3, 0.7))
    np.testing.assert_allclose(one.coefficients, two.coefficients, atol=1e-5)
    assert one.intercept == pytest.approx(two.intercept, abs=1e-5)


def test_spectra_stream_resumes_without_repeats(spark, tmp_path):
    model = scoring.LinearModel("ElasticNet", (1.0, 2.0), 10.0)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "id long, s array<double>"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)

    def run():
        arriving = stream.read_stream(spark, source, schema, max_files=1)
        query = stream.write_stream(stream.score_spectra(arriving, "id", "s", model), out, check)
        query.awaitTermination()
        return stream.describe(query)

    arrive([(1, [1.0, 1.0]), (2, [1.0]), (3, [None, 40.0])])
    run()
    arrive([(4, [0.0, 0.0])])
    run()
    got = {r["id"]: r for r in spark.read.parquet(out).collect()}
    assert len(got) == 4 == spark.read.parquet(out).count()
    assert got[1]["predicted_concentration"] == 13.0 and got[1]["confidence"] == "high"
    assert got[2]["reason"] == "Spectrum 2 has 1 values, expected 2" and got[2]["confidence"] is None
    assert got[3]["predicted_concentration"] == 90.0 and got[3]["confidence"] == "low"


def test_version_comparison_of_a_hot_model(spark):
    versions = spark.range(3000).selectExpr(
        "id AS version_id", "IF(id % 3 = 0, 7, id % 50 + 100) AS model_id", "string(id % 11) AS created_date", "'x' AS status"
    )
    compared = registry.version_comparison(versions)
    assert compared.count() == 3000
    newest = {}
    for r in versions.collect():
        newest[r["model_id"]] = max(newest.get(r["model_id"], ("", -1)), (r["created_date"], r["version_id"]))
    current = {r["model_id"]: r["version_id"] for r in compared.where("is_current").collect()}
    assert current == {m: v for m, (_, v) in newest.items()}


def test_audit_names_come_from_the_right_table(spark):
    audit = spark.createDataFrame(
        [(1, "models", 1), (2, "model_versions", 1), (3, "model_validations", 1), (4, "other", 1), (5, "models", None), (6, "models", 9)],
        "audit_id long, table_name string, record_id long",
    )
    models_df = spark.createDataFrame([(1, "PLS"), (2, "Hybrid")], "model_id long, model_name string")
    versions = spark.createDataFrame([(1, 2)], "version_id long, model_id long")
    validations = spark.createDataFrame([(1, 1)], "validation_id long, version_id long")
    got = {r["audit_id"]: r["model_name"] for r in registry.resolve_models(audit, models_df, versions, validations).collect()}
    assert got == {1: "PLS", 2: "Hybrid", 3: "Hybrid", 4: "N/A", 5: "N/A", 6: "N/A"}


def test_hidden_models_ignore_case(spark):
    models_df = spark.createDataFrame([(1, "PLS"), (2, "preprocessing v2")], "model_id long, model_name string")
    versions = spark.createDataFrame(
        [(1, 1, "2024-01-01", "Validated"), (2, 2, "2024-01-02", "Validated"), (3, 1, "2024-01-03", "Draft")],
        "version_id long, model_id long, created_date string, status string",
    )
    assert [r["version_id"] for r in registry.latest_validated(models_df, versions).collect()] == [1]
    row = registry.inventory(models_df, versions).first()
    assert (row["total_models"], row["validated_models"], row["total_validations"]) == (1, 1, 2)
    assert registry.inventory(models_df.limit(0), versions).withColumn("s", registry.approved_share("total_versions", "validated_models")).first()["s"] == 0.0
