"""Registry, joins and audit trail (survey sections 2.5 and 2.11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators import registry
from ..session import scratch_dir
from ..sources.registry_store import Registry
from ..sources.tables import read_parquet, staged
from .base import query, sql_round

HIDE = "%household%"

SQL_MODELS = """(SELECT c_custkey AS model_id, c_mktsegment || ' ' || c_name AS model_name FROM customer)"""
SQL_VERSIONS = """(SELECT o_orderkey AS version_id, o_custkey AS model_id, strftime(o_orderdate, '%Y-%m-%d') AS created_date,
                     CASE o_orderstatus WHEN 'F' THEN 'Validated' WHEN 'O' THEN 'In Development' ELSE 'Draft' END AS status
                   FROM orders)"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "c_mktsegment", "c_name")
    return read_parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"), name.alias("model_name"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("o_orderstatus")
    status = F.when(code == "F", "Validated").when(code == "O", "In Development").otherwise("Draft")
    return read_parquet(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("version_id"),
        F.col("o_custkey").alias("model_id"),
        F.to_date("o_orderdate").alias("created_date"),
        status.alias("status"),
    )


def day_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@query(
    "registry_latest",
    f"""SELECT model_name, version_id, created_date, status FROM {SQL_VERSIONS} JOIN {SQL_MODELS} USING (model_id)
        WHERE status = 'Validated' AND model_name NOT ILIKE '{HIDE}' ORDER BY created_date DESC, version_id""",
)
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_text(registry.latest_validated(models(spark, sf_dir), versions(spark, sf_dir), HIDE), "created_date")


@query(
    "registry_latest_sql",
    f"""SELECT model_name, version_id, created_date FROM {SQL_VERSIONS} JOIN {SQL_MODELS} USING (model_id)
        WHERE status = 'Validated' ORDER BY created_date DESC""",
)
def registry_latest_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry read through views and SQL."""
    models(spark, sf_dir).createOrReplaceTempView("registry_models")
    versions(spark, sf_dir).createOrReplaceTempView("registry_versions")
    return spark.sql(
        """SELECT m.model_name, v.version_id, CAST(v.created_date AS STRING) AS created_date
           FROM registry_models m JOIN registry_versions v ON m.model_id = v.model_id
           WHERE v.status = 'Validated' ORDER BY v.created_date DESC"""
    )


@query(
    "registry_inventory",
    f"""SELECT total_models, validated_models, development_models, total_versions, last_model_update,
              (SELECT count(*) FROM {SQL_VERSIONS} WHERE status = 'Validated') AS total_validations,
              (SELECT max(created_date) FROM {SQL_VERSIONS} WHERE status = 'Validated') AS last_validation,
              {sql_round('coalesce(validated_models / nullif(total_models, 0) * 100, 0)')} AS approved_share
        FROM (SELECT count(DISTINCT model_name) AS total_models,
                     count(CASE WHEN status = 'Validated' THEN 1 END) AS validated_models,
                     count(CASE WHEN status = 'In Development' THEN 1 END) AS development_models,
                     count(*) AS total_versions, max(created_date) AS last_model_update
              FROM {SQL_VERSIONS} JOIN {SQL_MODELS} USING (model_id) WHERE model_name NOT ILIKE '{HIDE}')""",
)
def registry_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = registry.inventory(models(spark, sf_dir), versions(spark, sf_dir), HIDE)
    counts = day_text(counts, "last_model_update", "last_validation")
    return counts.withColumn("approved_share", rounded(registry.approved_share("total_models", "validated_models")))


@query(
    "version_comparison",
    f"""SELECT version_id, model_id, created_date, current_version_id, version_id = current_version_id AS is_current
        FROM (SELECT *, first_value(version_id) OVER (PARTITION BY model_id ORDER BY created_date DESC, version_id DESC)
                        AS current_version_id FROM {SQL_VERSIONS})""",
)
def version_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = registry.version_comparison(versions(spark, sf_dir))
    columns = ["version_id", "model_id", "created_date", "current_version_id", "is_current"]
    return day_text(compared.select(*columns), "created_date")


@query(
    "latest_version",
    f"""SELECT model_id, version_id AS current_version_id, created_date AS "current_date" FROM {SQL_VERSIONS}
        QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY created_date DESC, version_id DESC) = 1""",
)
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_text(registry.latest_version(versions(spark, sf_dir)), "current_date")


@query(
    "version_options",
    """SELECT event_id AS version_id,
              'v' || event_id || ' (' || strftime(ts, '%Y-%m-%d') || ') - R²: ' || regexp_extract(props, '"k": ([0-9]+)', 1)
              || ', RMSE: N/A - ' || event_type AS option_text,
              CASE WHEN event_type = 'error' THEN 'Not Approved' ELSE 'user ' || user_id END AS approved_by
       FROM events""",
)
def version_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pick-list lines with metrics out of JSON; one metric is absent in these documents."""
    events = read_parquet(spark, sf_dir, "events")
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    listed = events.select(
        F.col("event_id").alias("version_id"),
        F.col("event_id").cast("string").alias("version_number"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_date"),
        F.col("event_type").alias("status"),
        F.col("props").alias("performance_metrics"),
        F.when(F.col("event_type") != "error", user).alias("approved_by"),
    )
    return registry.version_options(listed, r2_field="k", rmse_field="rmse")


@query(
    "status_class",
    """SELECT o_orderkey, status, CASE status WHEN 'APPROVED' THEN 'success' WHEN 'VALIDATED' THEN 'info'
              WHEN 'DRAFT' THEN 'warning' WHEN 'DEPRECATED' THEN 'danger' ELSE '' END AS display_class
       FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'APPROVED' WHEN '2-HIGH' THEN 'VALIDATED'
                    WHEN '3-MEDIUM' THEN 'DRAFT' WHEN '5-LOW' THEN 'DEPRECATED' ELSE 'RETIRED' END AS status FROM orders)""",
)
def status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.col("o_orderpriority")
    status = (
        F.when(level == "1-URGENT", "APPROVED").when(level == "2-HIGH", "VALIDATED").when(level == "3-MEDIUM", "DRAFT")
        .when(level == "5-LOW", "DEPRECATED").otherwise("RETIRED")
    )
    listed = read_parquet(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))
    return listed.withColumn("display_class", registry.display_class(F.col("status")))


@query(
    "registry_insert_absent",
    """SELECT p_partkey AS submission, 'Customer#' || lpad(p_partkey::VARCHAR, 9, '0') AS model_name,
              (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY p_partkey) AS model_id
       FROM part WHERE 'Customer#' || lpad(p_partkey::VARCHAR, 9, '0') NOT IN (SELECT c_name FROM customer)""",
)
def registry_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = read_parquet(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("model_id"), F.col("c_name").alias("model_name")
    )
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    incoming = read_parquet(spark, sf_dir, "part").select(F.col("p_partkey").alias("submission"), name.alias("model_name"))
    return registry.insert_absent(existing, incoming, stage=staging(spark)).select("submission", "model_name", "model_id")


def staging(spark: SparkSession):
    return lambda df: staged(df, scratch_dir(spark, "registry"))


SQL_SUBMITTED = """(SELECT p_partkey AS submission, CASE WHEN p_size % 10 > 0 THEN p_brand || ' ' || p_size END AS model_name,
                     0.6 + p_size / 100.0 AS r2, p_size / 20.0 AS rmse, p_size / 25.0 AS mae FROM part)"""


@query(
    "registry_register",
    f"""WITH first AS (SELECT * FROM {SQL_SUBMITTED} WHERE model_name IS NOT NULL
                        QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY submission) = 1),
             half AS (SELECT max(p_partkey) / 2 AS h FROM part),
             early AS (SELECT model_name, submission FROM first, half WHERE submission <= h),
             numbered AS (
               SELECT f.*, CASE WHEN e.model_name IS NOT NULL THEN row_number() OVER (PARTITION BY e.model_name IS NULL ORDER BY f.submission)
                                ELSE (SELECT count(*) FROM early) + row_number() OVER (PARTITION BY e.model_name IS NULL ORDER BY f.submission) END AS model_id,
                      r2 > 0.7 AND rmse < 2.0 AND mae < 1.5 AS passed
               FROM first f LEFT JOIN early e USING (model_name))
        SELECT model_id, model_name, model_id AS version_id, '1.0.0' AS version_number, CASE WHEN passed THEN 'Validated' ELSE 'In Development' END AS status,
               CASE WHEN passed THEN 'Passed' ELSE 'Failed' END AS validation_result, CASE WHEN passed THEN 'Production' END AS environment
        FROM numbered""",
)
def registry_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of submissions with repeated and missing names; then all four written tables joined."""
    size = F.col("p_size")
    submitted = read_parquet(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("submission"),
        F.when(size % 10 > 0, F.concat("p_brand", F.lit(" "), size.cast("string"))).alias("model_name"),
        F.lit("Hybrid").alias("model_type"), F.col("p_name").alias("description"), F.lit("query").alias("created_by"),
        F.lit("models/").alias("file_path"), F.md5("p_name").alias("file_hash"),
        F.struct((size / 100.0 + 0.6).alias("r2_score"), (size / 20.0).alias("rmse"), (size / 25.0).alias("mae")).alias("performance_metrics"),
        F.struct(size.alias("layers")).alias("parameters"), F.struct(F.lit(4000).alias("training_samples")).alias("data_info"),
    )
    half = submitted.agg(F.max("submission") / 2).scalar()
    store = Registry(spark, scratch_dir(spark, "registry-tables"))
    store.register(submitted.where(F.col("submission") <= half))
    store.register(submitted)
    models, versions, checks, used = (store.table(n) for n in ("models", "model_versions", "model_validations", "model_deployments"))
    return (
        models.select("model_id", "model_name")
        .join(versions.select("model_id", "version_id", "version_number", "status"), "model_id")
        .join(checks.select("version_id", "validation_result"), "version_id")
        .join(used.select("version_id", "environment"), "version_id", "left")
    )


@query(
    "registry_all_versions",
    f"""SELECT model_name, version_id, created_date, status,
              CASE upper(status) WHEN 'APPROVED' THEN 'success' WHEN 'VALIDATED' THEN 'info' WHEN 'DRAFT' THEN 'warning'
                   WHEN 'DEPRECATED' THEN 'danger' ELSE '' END AS display_class
        FROM {SQL_VERSIONS} JOIN {SQL_MODELS} USING (model_id) WHERE model_name NOT ILIKE '{HIDE}'
        ORDER BY created_date DESC, version_id""",
)
def registry_all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_text(registry.all_versions(models(spark, sf_dir), versions(spark, sf_dir), HIDE), "created_date")


@query(
    "registry_family",
    f"""SELECT model_name, version_id, created_date, status FROM {SQL_VERSIONS} JOIN {SQL_MODELS} USING (model_id)
        WHERE model_name LIKE 'BUILDING%' ORDER BY created_date DESC, version_id""",
)
def registry_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_text(registry.versions_of_family(models(spark, sf_dir), versions(spark, sf_dir), "BUILDING%"), "created_date")


SQL_AUDIT = """(SELECT event_id AS audit_id, ts, user_id AS record_id,
                  CASE event_type WHEN 'signup' THEN 'models' WHEN 'purchase' THEN 'model_versions'
                       WHEN 'view' THEN 'model_validations' ELSE 'model_deployments' END AS table_name FROM events)"""
SQL_AUDIT_NAMED = f"""
    SELECT audit_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS audit_date, table_name, record_id,
           coalesce(CASE table_name WHEN 'models' THEN n1.n_name WHEN 'model_versions' THEN n2.n_name
                    WHEN 'model_validations' THEN n3.n_name END, 'N/A') AS model_name
    FROM {SQL_AUDIT}
    LEFT JOIN nation n1 ON n1.n_nationkey = record_id
    LEFT JOIN customer c2 ON c2.c_custkey = record_id LEFT JOIN nation n2 ON n2.n_nationkey = c2.c_nationkey
    LEFT JOIN orders o3 ON o3.o_orderkey = record_id LEFT JOIN customer c3 ON c3.c_custkey = o3.o_custkey
    LEFT JOIN nation n3 ON n3.n_nationkey = c3.c_nationkey"""


def audit_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Audit trail, models (nations), versions (customers) and validations (orders)."""
    kind = F.col("event_type")
    table = (
        F.when(kind == "signup", "models").when(kind == "purchase", "model_versions")
        .when(kind == "view", "model_validations").otherwise("model_deployments")
    )
    audit = read_parquet(spark, sf_dir, "events").select(
        F.col("event_id").alias("audit_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("audit_date"),
        table.alias("table_name"),
        F.col("user_id").alias("record_id"),
        kind.alias("action"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("user_name"),
        F.col("props").alias("reason"),
    )
    named = read_parquet(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("model_id"), F.col("n_name").alias("model_name")
    )
    version = read_parquet(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("version_id"), F.col("c_nationkey").cast("long").alias("model_id")
    )
    validation = read_parquet(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("validation_id"), F.col("o_custkey").alias("version_id")
    )
    return audit, named, version, validation


@query("audit_with_model", SQL_AUDIT_NAMED)
def audit_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole trail with the model behind each record."""
    resolved = registry.resolve_models(*audit_tables(spark, sf_dir))
    return resolved.select("audit_id", "audit_date", "table_name", "record_id", "model_name")


@query("audit_recent", f"SELECT * FROM ({SQL_AUDIT_NAMED}) ORDER BY audit_date DESC, audit_id DESC LIMIT 10")
def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = registry.recent_activity(*audit_tables(spark, sf_dir), n=10)
    return resolved.select("audit_id", "audit_date", "table_name", "record_id", "model_name")


@query("audit_details", f"""SELECT a.*, event_type AS action, 'user ' || user_id AS user_name, props AS reason
                            FROM ({SQL_AUDIT_NAMED}) a JOIN events ON event_id = audit_id""")
def audit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail with model, action, user and reason."""
    return registry.resolve_models(*audit_tables(spark, sf_dir))
