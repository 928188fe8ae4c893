"""Fitted models on shared storage.

Spark pipelines use their own persistence. Linear models are a small table of
coefficients, readable by any job.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from ..operators.scoring import LinearModel
from ..operators.spectral import Scaler
from .tables import table_or_none

SCHEMA = "name string, position int, coefficient double"
SCALER_SCHEMA = "position int, mean double, divisor double"
INTERCEPT = -1


class NotFittedError(ValueError):
    """A stored model has no coefficients."""


def stamped_path(folder: str, kind: str, now: datetime | None = None) -> str:
    """``folder/kind_yyyymmdd_hhmmss`` with the kind in lower case and without blanks."""
    moment = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    return f"{folder.rstrip('/')}/{kind.lower().replace(' ', '_')}_{moment}"


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    model = PipelineModel.load(path)
    if not model.stages:
        raise NotFittedError(f"no fitted stages in {path}")
    return model


def save_linear(spark: SparkSession, model: LinearModel, path: str) -> None:
    rows = [(model.name, i, c) for i, c in enumerate(model.coefficients)]
    rows.append((model.name, INTERCEPT, model.intercept))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str) -> LinearModel:
    rows = spark.read.schema(SCHEMA).parquet(path).collect()  # one row per coefficient
    values = {r["position"]: r["coefficient"] for r in rows}
    if len(values) < 2 or INTERCEPT not in values:
        raise NotFittedError(f"no coefficients in {path}")
    coefficients = tuple(values[i] for i in range(len(values) - 1))
    return LinearModel(rows[0]["name"], coefficients, values[INTERCEPT])


def load_optional(spark: SparkSession, path: str) -> LinearModel | None:
    """The second model of a run may be missing; its predictions are NULL then."""
    return None if table_or_none(spark, path, SCHEMA) is None else load_linear(spark, path)


def save_scaler(spark: SparkSession, scaler: Scaler, path: str) -> None:
    """The fitted means and divisors, one row per point, stored beside the model."""
    rows = [(i, m, d) for i, (m, d) in enumerate(zip(scaler.means, scaler.divisors))]
    spark.createDataFrame(rows, SCALER_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> Scaler:
    rows = sorted(spark.read.schema(SCALER_SCHEMA).parquet(path).collect())  # one row per point
    if [r["position"] for r in rows] != list(range(len(rows))) or not rows:
        raise NotFittedError(f"no complete scaler in {path}")
    return Scaler(tuple(r["mean"] for r in rows), tuple(r["divisor"] for r in rows))
