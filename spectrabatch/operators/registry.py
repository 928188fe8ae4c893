"""Model registry and audit trail as tables.

One schema throughout: ``created_date`` and ``status`` (see README for the two
namings it replaces).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import positions

# What the registry counts, hides and displays.
VALIDATED = "Validated"
IN_DEVELOPMENT = "In Development"
HIDDEN_MODELS = "%Preprocessing%"
NOT_AVAILABLE = "N/A"
NOT_APPROVED = "Not Approved"
SALTS = 16
DISPLAY_CLASSES = {
    "APPROVED": "success",
    "VALIDATED": "info",
    "DRAFT": "warning",
    "DEPRECATED": "danger",
}


def versions_with_models(models: DataFrame, versions: DataFrame, hide: str = HIDDEN_MODELS) -> DataFrame:
    """Inner join without hidden models. ``ilike`` because the pattern ignores case."""
    return versions.join(models.where(~F.col("model_name").ilike(hide)), "model_id")


def latest_validated(models: DataFrame, versions: DataFrame, hide: str = HIDDEN_MODELS) -> DataFrame:
    """Validated versions, newest first."""
    joined = versions_with_models(models, versions.where(F.col("status") == VALIDATED), hide)
    return joined.select("model_name", "version_id", "created_date", "status").orderBy(
        F.desc("created_date"), "version_id"
    )


def all_versions(models: DataFrame, versions: DataFrame, hide: str = HIDDEN_MODELS) -> DataFrame:
    """Versions in every state, newest first, with their display class."""
    joined = versions_with_models(models, versions, hide)
    shown = joined.select("model_name", "version_id", "created_date", "status", display_class(F.upper("status")).alias("display_class"))
    return shown.orderBy(F.desc("created_date"), "version_id")


def versions_of_family(models: DataFrame, versions: DataFrame, family: str) -> DataFrame:
    """All versions of the models whose name fits the pattern, newest first."""
    joined = versions.join(models.where(F.col("model_name").like(family)), "model_id")
    return joined.select("model_name", "version_id", "created_date", "status").orderBy(F.desc("created_date"), "version_id")


def inventory(models: DataFrame, versions: DataFrame, hide: str = HIDDEN_MODELS) -> DataFrame:
    """One row of counts; the validations are counted without the name filter."""
    validations = versions.where(F.col("status") == VALIDATED).agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.max("created_date").alias("last"))
    ).scalar()
    counts = versions_with_models(models, versions, hide).agg(
        F.countDistinct("model_name").alias("total_models"),
        F.count_if(F.col("status") == VALIDATED).alias("validated_models"),
        F.count_if(F.col("status") == IN_DEVELOPMENT).alias("development_models"),
        F.count(F.lit(1)).alias("total_versions"),
        F.max("created_date").alias("last_model_update"),
    )
    return counts.withColumns(
        {"total_validations": validations["n"], "last_validation": validations["last"]}
    )


def approved_share(total: str, approved: str) -> Column:
    """Percentage, 0 for an empty registry."""
    return F.coalesce(F.try_divide(F.col(approved), F.col(total)) * 100, F.lit(0.0))


def latest_version(versions: DataFrame) -> DataFrame:
    """The newest version of each model: a maximum of a struct, which merges partial results."""
    newest = F.max(F.struct("created_date", "version_id")).alias("newest")
    return versions.groupBy("model_id").agg(newest).select(
        "model_id",
        F.col("newest.version_id").alias("current_version_id"),
        F.col("newest.created_date").alias("current_date"),
    )


def version_comparison(versions: DataFrame) -> DataFrame:
    """Every version beside the current version of its model.

    The current versions come out of an aggregate on the join key, where the
    adaptive split of skewed joins does not apply. Salting the join spreads a
    model that holds much of all versions.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    current = latest_version(versions).select("*", salts)
    salted = versions.withColumn("_salt", F.pmod(F.xxhash64("version_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(current, ["model_id", "_salt"]).drop("_salt")
    return joined.withColumn("is_current", F.col("version_id") == F.col("current_version_id"))


def version_options(versions: DataFrame, r2_field: str = "r2_score", rmse_field: str = "rmse") -> DataFrame:
    """Pick-list line of each version: number, date, metrics from JSON, status.

    The document is parsed once; absent or malformed metrics show as N/A.
    """
    metrics = F.from_json("performance_metrics", f"`{r2_field}` string, `{rmse_field}` string")
    shown = [F.coalesce(metrics[field], F.lit(NOT_AVAILABLE)) for field in (r2_field, rmse_field)]
    day = F.substring("created_date", 1, 10)
    line = F.concat(
        F.lit("v"), "version_number", F.lit(" ("), day, F.lit(") - R²: "), shown[0], F.lit(", RMSE: "), shown[1],
        F.lit(" - "), "status",
    )
    return versions.select(
        "version_id",
        line.alias("option_text"),
        F.coalesce("approved_by", F.lit(NOT_APPROVED)).alias("approved_by"),
    )


def display_class(status: Column) -> Column:
    """Display class of a status; empty for an unknown one."""
    chain = F.lit("")
    for name, shown in DISPLAY_CLASSES.items():
        chain = F.when(status == name, shown).otherwise(chain)
    return chain


def insert_absent(
    existing: DataFrame, incoming: DataFrame, used_ids: DataFrame | None = None, stage: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Incoming models whose name is new, with ids that continue the used ones.

    ``incoming`` has a unique numeric ``submission`` that fixes the id order. Of
    several submissions of one name the first counts, and those without a name
    are left out. ``used_ids`` names further taken ids in ``model_id``. Numbering
    reads the new rows several times; ``stage`` may write them once.
    """
    first = W.partitionBy("model_name").orderBy("submission")
    named = incoming.where(F.col("model_name").isNotNull()).withColumn("_first", F.row_number().over(first))
    new = named.where(F.col("_first") == 1).drop("_first").join(existing.select("model_name"), "model_name", "left_anti")
    new = new if stage is None else stage(new)
    taken = existing.select("model_id")
    if used_ids is not None:
        taken = taken.union(used_ids.select("model_id"))
    top = taken.agg(F.coalesce(F.max("model_id"), F.lit(0))).scalar()
    numbered = positions.with_position(new, "submission", "_number")
    return numbered.withColumn("model_id", top + F.col("_number")).drop("_number")


def resolve_models(audit: DataFrame, models: DataFrame, versions: DataFrame, validations: DataFrame) -> DataFrame:
    """Adds the model behind each audit record, ``N/A`` if there is none.

    The three lookups become one table keyed by (table, record), so the trail
    is joined once. Three joins with the key set to NULL for foreign tables
    would send those rows to a single partition.
    """
    by_model = models.select(F.lit("models").alias("table_name"), F.col("model_id").alias("record_id"), "model_name")
    named = versions.join(models, "model_id")
    by_version = named.select(F.lit("model_versions"), "version_id", "model_name")
    by_validation = validations.join(named, "version_id").select(
        F.lit("model_validations"), "validation_id", "model_name"
    )
    lookup = by_model.union(by_version).union(by_validation)
    pointing = audit.where(F.col("record_id").isNotNull() & F.col("table_name").isNotNull())
    others = audit.where(F.col("record_id").isNull() | F.col("table_name").isNull())  # they would share one join key
    resolved = pointing.join(lookup, ["table_name", "record_id"], "left")
    resolved = resolved.unionByName(others.withColumn("model_name", F.lit(None).cast("string")))
    return resolved.withColumn("model_name", F.coalesce("model_name", F.lit(NOT_AVAILABLE)))


def recent_activity(audit: DataFrame, models: DataFrame, versions: DataFrame, validations: DataFrame, n: int = 10) -> DataFrame:
    """The latest ``n`` records with their model.

    The few records come to the driver first; their ids then reach the readers
    of the three tables as pushed filters, so nothing is joined whole.
    """
    newest = [F.desc("audit_date"), F.desc("audit_id")]
    rows = audit.orderBy(*newest).limit(n).collect()
    latest = audit.sparkSession.createDataFrame(rows, audit.schema)

    def ids(table: str) -> list:
        return sorted({r["record_id"] for r in rows if r["table_name"] == table and r["record_id"] is not None})

    checked = validations.where(F.col("validation_id").isin(ids("model_validations")))
    of_checked = [r["version_id"] for r in checked.select("version_id").distinct().collect()]  # at most n
    wanted = sorted({*ids("model_versions"), *(v for v in of_checked if v is not None)})
    named = versions.where(F.col("version_id").isin(wanted))
    return resolve_models(latest, models, named, checked).orderBy(*newest)
