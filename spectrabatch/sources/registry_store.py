"""Registry tables on shared storage: models, versions, validations, deployments."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import insert_absent
from ..session import scratch_dir
from .tables import staged, table_or_none

SCHEMAS = {
    "models": "model_id long, model_name string, model_type string, description string, created_by string, "
    "created_date timestamp, status string, is_active boolean",
    "model_versions": "version_id long, model_id long, version_number string, file_path string, file_hash string, "
    "model_parameters string, training_data_info string, performance_metrics string, created_by string, "
    "created_date timestamp, status string, approved_by string, change_reason string",
    "model_validations": "validation_id long, version_id long, validation_type string, validation_date timestamp, "
    "performed_by string, dataset_info string, metrics string, acceptance_criteria string, "
    "validation_result string, comments string",
    "model_deployments": "deployment_id long, version_id long, environment string, deployment_date timestamp, "
    "deployed_by string, deployment_status string",
}

#: What a batch is, with every id it will have, before any table is written.
JOURNAL = (
    "batch string, batch_rows long, model_id long, version_id long, validation_id long, deployment_id long, model_name string, "
    "model_type string, description string, created_by string, created_date timestamp, file_path string, file_hash string, "
    "model_parameters string, training_data_info string, metrics string, passed boolean"
)

# First version, states of a new entry, acceptance limits.
FIRST_VERSION = "1.0.0"
LIMITS = {"r2_threshold": 0.7, "rmse_threshold": 2.0, "mae_threshold": 1.5}


KEYS = {"model_versions": "version_id", "model_validations": "validation_id", "model_deployments": "deployment_id"}


class Registry:
    """Four tables that are written by submission batch, each batch in a folder of its own.

    A batch is first written, with all its ids, to a journal; then its rows go to
    the four tables and its name to the list of finished batches. Every write
    replaces the batch's own folder, so it can be repeated. ``register`` finishes
    journals that a stopped run left before it starts, and a batch that is submitted
    again under its name changes nothing once it is finished. One writer at a time:
    Parquet folders have no locks.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        found = table_or_none(self.spark, f"{self.folder}/{name}", schema, nested=True)
        return self.spark.createDataFrame([], schema) if found is None else found

    def _write(self, name: str, batch: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{batch}")

    def table(self, name: str) -> DataFrame:
        return self._read(name, SCHEMAS[name])

    def register_views(self) -> None:
        """Make the tables available to ``spark.sql``."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)

    def finished(self) -> DataFrame:
        """Names of the batches whose rows are all in place."""
        return self._read("finished", "batch string")

    def recover(self) -> list[str]:
        """Finish the batches whose journal is whole but whose writes were stopped; their names."""
        journals = self._read("journal", JOURNAL).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.max("batch_rows").alias("rows"))
        open_batches = journals.where("n = rows").join(self.finished(), "batch", "left_anti")
        names = sorted(r["batch"] for r in open_batches.collect())  # one writer leaves one open batch at most
        for name in names:
            self._apply(name)
        return names

    def register(self, submissions: DataFrame, batch: str | None = None) -> int:
        """Insert models that are not there yet, each with version, validation and deployment.

        ``submissions``: submission long (unique), model_name, model_type, description, created_by,
        file_path, file_hash, performance_metrics struct(r2_score, rmse, mae), parameters struct,
        data_info struct. ``batch`` names the submissions for a job that may be repeated. Returns
        the number of new models.
        """
        recovered = self.recover()
        batch = uuid.uuid4().hex if batch is None else batch
        if batch in recovered:
            return self._read("journal", JOURNAL).where(F.col("batch") == batch).count()
        if self.finished().where(F.col("batch") == batch).count():
            return 0
        # An interrupted run of an older layout may have left versions without a model: their ids stay taken.
        new = insert_absent(self.table("models"), submissions, self.table("model_versions"), lambda df: staged(df, scratch_dir(self.spark, "registry")))
        numbered = new.withColumn("created_date", F.current_timestamp())
        facts = numbered.agg(F.count(F.lit(1)).alias("rows"), F.min("model_id").alias("first")).first()
        if not facts["rows"]:
            return 0
        tops = reduce(DataFrame.unionByName, [self.table(name).agg(F.max(key).alias("top")).select(F.lit(key).alias("key"), "top") for name, key in KEYS.items()])
        top = {r["key"]: r["top"] or 0 for r in tops.collect()}
        number = F.col("model_id") - facts["first"] + 1
        ids = {key: F.lit(top[key]) + number for key in KEYS.values()}
        metrics = F.col("performance_metrics")
        passed = (
            (metrics["r2_score"] > LIMITS["r2_threshold"])
            & (metrics["rmse"] < LIMITS["rmse_threshold"])
            & (metrics["mae"] < LIMITS["mae_threshold"])
        )
        planned = numbered.withColumns(
            {
                **ids,
                "passed": F.coalesce(passed, F.lit(False)),
                "model_parameters": F.to_json("parameters"),
                "training_data_info": F.to_json("data_info"),
                "metrics": F.to_json("performance_metrics"),
                "batch": F.lit(batch),
                "batch_rows": F.lit(facts["rows"]),
            }
        )
        names = self.spark.createDataFrame([], JOURNAL).columns
        self._write("journal", batch, planned.select(*names))
        self._apply(batch)
        return facts["rows"]

    def _apply(self, batch: str) -> None:
        """Bring the rows of a whole journal to the four tables."""
        passed = F.col("passed")
        linked = self._read("journal", JOURNAL).where(F.col("batch") == batch).withColumns(
            {
                "version_number": F.lit(FIRST_VERSION),
                "dataset_info": F.col("training_data_info"),
                "performance_metrics": F.col("metrics"),
                "acceptance_criteria": F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in LIMITS.items()])),
                "validation_result": F.when(passed, "Passed").otherwise("Failed"),
                "validation_type": F.lit("IQ/OQ/PQ"),
                "validation_date": F.col("created_date"),
                "deployment_date": F.col("created_date"),
                "performed_by": F.col("created_by"),
                "deployed_by": F.col("created_by"),
                "environment": F.lit("Production"),
                "deployment_status": F.lit("Active"),
                "status": F.when(passed, "Validated").otherwise("In Development"),
                "approved_by": F.lit(None).cast("string"),
                "change_reason": F.lit("Initial registration"),
                "comments": F.lit(None).cast("string"),
                "is_active": F.lit(True),
            }
        )
        # Children first and models last: readers see no model without its version.
        # A model that failed validation is not deployed.
        rows = {
            "model_deployments": linked.where(passed),
            "model_validations": linked,
            "model_versions": linked,
            "models": linked.withColumn("status", F.lit("Active")),
        }
        for name, part in rows.items():
            self._write(name, batch, part.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns))
        self._write("finished", batch, self.spark.createDataFrame([(batch,)], "batch string"))
