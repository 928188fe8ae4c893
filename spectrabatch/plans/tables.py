"""Sources, projection, reshaping and cleaning (survey sections 2.1 to 2.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays
from ..functions import names as naming
from ..functions.numeric import rounded
from ..operators import cleaning, schema, spectral, tiles
from ..session import scratch_dir
from ..sources import ingest, tables
from .base import (
    AXIS, BATCH_LABELS, POINTS, SQL_SPECTRA, lineitem, query, spectra, sql_long, sql_round, targets, wide_spectra,
)


@query(
    "csv_roundtrip",
    "SELECT event_id, user_id, event_type, value, props FROM events",
)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.read_parquet(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    path = scratch_dir(spark, "csv")
    tables.write_csv(events, path)
    return tables.read_csv(spark, path, events.schema)


@query(
    "first_n_samples",
    "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 100",
)
def first_n_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.first_rows(targets(spark, sf_dir), "event_id", 100)


@query(
    "row_slice",
    "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 1108 OFFSET 100",
)
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.row_slice(targets(spark, sf_dir), "event_id", 100, 1208)


@query(
    "dataset_overview",
    """SELECT count(*) AS n_rows, CAST(2 + max(len(embedding)) AS BIGINT) AS n_columns,
              CAST(1 AS BIGINT) AS n_process, CAST(max(len(embedding)) AS BIGINT) AS n_spectral
       FROM embeddings""",
)
def dataset_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.overview(wide_spectra(spark, sf_dir), target="label")


@query("schema_contract", "SELECT l_tax, l_quantity, l_returnflag FROM lineitem")
def schema_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns a model expects, in its order."""
    return schema.require_columns(lineitem(spark, sf_dir), ["l_tax", "l_quantity", "l_returnflag"])


@query(
    "text_parts",
    """SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS stem,
              CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END AS brand,
              string_split(p_name, ' ')[-1] AS noun FROM part""",
)
def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text functions of file names and labels as columns."""
    part = tables.read_parquet(spark, sf_dir, "part")
    return part.select(
        "p_partkey", naming.file_stem(F.col("p_name")).alias("stem"),
        naming.without_prefix(F.col("p_brand"), "Brand#").alias("brand"), naming.last_part(F.col("p_name"), " ").alias("noun"),
    )


@query(
    "split_blocks",
    "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem",
)
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, right = schema.split_at(lineitem(spark, sf_dir), "l_quantity")
    return schema.features_without(right, "l_extendedprice", "l_shipdate")


@query(
    "swap_columns",
    """SELECT l_orderkey, l_suppkey AS l_partkey, l_partkey AS l_suppkey, l_linenumber, l_quantity
       FROM lineitem""",
)
def swap_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = lineitem(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return schema.swap_columns(chosen, "l_partkey", "l_suppkey")


@query(
    "reindex_fill",
    "SELECT l_orderkey, l_quantity, CAST(0.0 AS DOUBLE) AS l_absent, l_tax FROM lineitem",
)
def reindex_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.reindex(lineitem(spark, sf_dir), ["l_orderkey", "l_quantity", "l_absent", "l_tax"])


@query(
    "spectrum_slice",
    sql_long(f"(SELECT vec_id, s[11:40] AS s FROM {SQL_SPECTRA})", 30, 500.0),
)
def spectrum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = spectra(spark, sf_dir).withColumn("spectrum", arrays.position_slice(F.col("spectrum"), 10, 40))
    return _long(cut, AXIS[10:40])


@query(
    "rejoin_blocks",
    f"""SELECT vec_id, label, {sql_round('s[1] + s[64]')} AS end_sum FROM {SQL_SPECTRA}""",
)
def rejoin_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side-by-side join of the label block and the spectral block."""
    both = schema.rejoin(
        spectra(spark, sf_dir).select("vec_id", "label"), spectra(spark, sf_dir).select("vec_id", "spectrum"), "vec_id"
    )
    ends = F.get("spectrum", F.lit(0)) + F.element_at("spectrum", -1)
    return both.select("vec_id", "label", rounded(ends).alias("end_sum"))


@query("spectra_long", sql_long(SQL_SPECTRA, POINTS, 200.0))
def spectra_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spectra(spark, sf_dir), AXIS)


@query("spectra_unpivot", sql_long(SQL_SPECTRA, POINTS, 200.0))
def spectra_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_spectra(spark, sf_dir)
    long = spectral.wide_to_long(wide, ["vec_id"], [f"{int(w)}" for w in AXIS])
    return long.withColumn("intensity", rounded(F.col("intensity"), 9))


@query("spectra_packed", sql_long(SQL_SPECTRA, POINTS, 200.0))
def spectra_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table with descending axis, packed into an ascending array."""
    wide = wide_spectra(spark, sf_dir)
    names = [c for c in wide.columns if c[0].isdigit()]
    descending = wide.select("vec_id", "label", *[f"`{n}`" for n in reversed(names)])
    packed, axis = spectral.pack_spectrum(descending, names)
    return _long(packed, axis)


@query(
    "spectra_transposed",
    f"""SELECT CAST(200.0 + 30.0 * (i - 1) AS DOUBLE) AS wl,
              {', '.join(f"{sql_round(f'avg(v) FILTER (label = {k})')} AS s_{k}" for k in BATCH_LABELS)}
       FROM (SELECT label, unnest(range(1, {POINTS} + 1)) AS i, unnest(s) AS v FROM {SQL_SPECTRA})
       GROUP BY i""",
)
def spectra_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spectra(spark, sf_dir)
    present = {r["label"] for r in table.select("label").distinct().limit(len(BATCH_LABELS) + 1).collect()}
    if not present <= set(BATCH_LABELS):
        raise ValueError(f"labels beside {BATCH_LABELS}")  # a label must not vanish
    wide = spectral.transposed(table, "spectrum", AXIS, "label", BATCH_LABELS)
    return wide.select("wl", *[rounded(F.col(f"s_{k}")).alias(f"s_{k}") for k in BATCH_LABELS])


@query(
    "rows_transposed",
    f"""SELECT CAST(200.0 + 30.0 * (i - 1) AS DOUBLE) AS wl, {', '.join(f"{sql_round(f'max(v) FILTER (vec_id = {k})')} AS s_{k}" for k in range(10, 20))}
       FROM (SELECT vec_id, unnest(range(1, {POINTS} + 1)) AS i, unnest(s) AS v FROM {SQL_SPECTRA} WHERE vec_id BETWEEN 10 AND 19)
       WHERE 200.0 + 30.0 * (i - 1) BETWEEN 350 AND 1000 GROUP BY i""",
)
def rows_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of rows by a range of the axis, turned around."""
    wide = spectral.transpose_rows(spectra(spark, sf_dir), "vec_id", 10, 19, "spectrum", AXIS, 350.0, 1000.0)
    return wide.select("wl", *[rounded(F.col(c)).alias(c) for c in wide.columns[1:]])


# Each piece by its length, ends and two sums, the second one weighted by place.
@query(
    "tiles_transposed",
    f"""SELECT wl, (rn - 1) // 512 AS block, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id,
              {sql_round('sum(v)', 5)} AS total, {sql_round('sum(v * ((rn - 1) % 512))', 5)} AS weighted
       FROM (SELECT vec_id, rn, CAST(200.0 + 30.0 * (i - 1) AS DOUBLE) AS wl, s[i] AS v
             FROM (SELECT vec_id, s, row_number() OVER (ORDER BY vec_id) AS rn, unnest(range(1, {POINTS} + 1)) AS i FROM {SQL_SPECTRA}))
       GROUP BY ALL""",
)
def tiles_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spectra turned around: a row per point, in pieces of 512 samples."""
    turned = tiles.turned(tiles.tiled(spectra(spark, sf_dir), "vec_id", "spectrum", AXIS, 512, 16))
    pieces = tiles.pieces(turned, "wl", "ids", "v")
    weighted = F.zip_with("v", F.sequence(F.lit(0), F.size("v") - 1), lambda v, i: v * i)
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda t, v: t + v), 5)
    return pieces.select(
        "wl", "block", F.size("v").cast("long").alias("n"), F.element_at("ids", 1).alias("first_id"),
        F.element_at("ids", -1).alias("last_id"), total("v").alias("total"), total(weighted).alias("weighted"),
    )


@query(
    "tiles_turned_back",
    f"SELECT vec_id, CAST(len(s) AS BIGINT) AS points, {sql_round('s[1]', 9)} AS first_value, {sql_round('s[17]', 9)} AS inner_value, {sql_round('s[64]', 9)} AS last_value FROM {SQL_SPECTRA}",
)
def tiles_turned_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned around twice and joined to whole spectra again."""
    layout = tiles.tiled(spectra(spark, sf_dir), "vec_id", "spectrum", AXIS, 512, 16)
    back = tiles.joined(tiles.turned(tiles.turned(layout)), "vec_id", "s")
    at = lambda i: rounded(F.element_at("s", i), 9)
    return back.select("vec_id", F.size("s").cast("long").alias("points"), at(1).alias("first_value"), at(17).alias("inner_value"), at(64).alias("last_value"))


@query(
    "ragged_smoothed",
    f"""SELECT vec_id, CASE WHEN label <> 7 THEN {sql_round('list_sum([(s[i - 1] + s[i] + s[i + 1]) / 3 FOR i IN range(2, 64)]) + (2 * s[1] + s[2]) / 3 + (s[63] + 2 * s[64]) / 3')} END AS smoothed_sum,
              CASE WHEN label = 7 THEN 'Spectrum ' || vec_id || ' has 60 values, expected 64' END AS reason
       FROM {SQL_SPECTRA}""",
)
def ragged_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of another length keep a reason; the others are smoothed."""
    ragged = spectra(spark, sf_dir).select("vec_id", F.when(F.col("label") == 7, F.slice("spectrum", 1, 60)).otherwise(F.col("spectrum")).alias("spectrum"))
    checked = cleaning.validate_length(ragged, "vec_id", "spectrum", POINTS)
    usable = checked.withColumn("spectrum", F.when(F.col("reason").isNull(), F.col("spectrum")))
    smooth = spectral.savgol_smooth(usable, "spectrum", POINTS, 3, 1)
    return smooth.select("vec_id", rounded(F.aggregate("spectrum", F.lit(0.0), lambda t, v: t + v)).alias("smoothed_sum"), "reason")


@query("wide_csv_samples", f"SELECT vec_id, {sql_round('list_sum(s)', 5)} AS total, CAST(len(s) AS BIGINT) AS points FROM {SQL_SPECTRA}")
def wide_csv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide sample file, read by its header and packed."""
    path = scratch_dir(spark, "wide-csv")
    tables.write_csv(wide_spectra(spark, sf_dir), path)
    wide = tables.read_samples_csv(spark, path)
    packed, _ = spectral.pack_spectrum(wide, [c for c in wide.columns if c[0].isdigit()])
    total = F.aggregate("spectrum", F.lit(0.0), lambda t, v: t + v)
    return packed.select(F.col("vec_id").cast("long").alias("vec_id"), rounded(total, 5).alias("total"), F.size("spectrum").cast("long").alias("points"))


@query(
    "csv_rejected",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value, user_id % 50 <> 0 AND event_type <> 'error' AS clean,
              CASE WHEN user_id % 50 = 0 THEN '2 fields, expected 3'
                   WHEN event_type = 'error' THEN 'value: ''sensor fault'' is no number' END AS reason
       FROM events""",
)
def csv_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with broken numbers and short rows: every row is there once, clean or with its reason."""
    events = tables.read_parquet(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", "sensor fault").otherwise(F.col("value").cast("string"))
    line = F.concat_ws(",", F.col("event_id").cast("string"), value, F.when(F.col("user_id") % 50 != 0, F.col("user_id").cast("string")))
    path = scratch_dir(spark, "dirty-csv")
    # The first line of every file is its header.
    events.select(line.alias("event_id,value,user_id")).write.options(header="true", sep=ingest.NO_SEPARATOR, quote="", escape="").csv(path)
    read = T.StructType.fromDDL("event_id long, value double, user_id long")
    good, bad = ingest.read_samples_checked(spark, path, read, "event_id")
    kept = good.select("event_id", "value", F.lit(True).alias("clean"), F.lit(None).cast("string").alias("reason"))
    # The value of a short row is still in its text.
    told = F.try_element_at(F.split("line", ","), F.lit(2)).try_cast("double")
    return kept.unionAll(bad.select("event_id", told.alias("value"), F.lit(False).alias("clean"), "reason"))


@query(
    "requests_rejected",
    f"""SELECT vec_id AS request_id, CASE label WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 7 THEN NULL ELSE {sql_round('list_sum(s)', 5)} END AS total,
              CASE label WHEN 1 THEN 'spectral_values[3] is no number' WHEN 2 THEN 'spectral_values is no list'
                         WHEN 7 THEN 'Spectrum ' || vec_id || ' has 60 values, expected 64' END AS reason
       FROM {SQL_SPECTRA}""",
)
def requests_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with text among the numbers, text instead of them, and too few of them."""
    values = F.col("spectrum").cast("array<string>")
    body = (
        F.when(F.col("label") == 1, F.concat(F.lit("["), F.array_join(F.slice(values, 1, 3), ","), F.lit(',"dark"]')))
        .when(F.col("label") == 2, F.lit('"none"'))
        .otherwise(F.concat(F.lit("["), F.array_join(F.when(F.col("label") == 7, F.slice(values, 1, 60)).otherwise(values), ","), F.lit("]")))
    )
    line = F.concat(F.lit('{"request_id": '), F.col("vec_id").cast("string"), F.lit(', "spectral_values": '), body, F.lit("}"))
    path = scratch_dir(spark, "dirty-requests")
    spectra(spark, sf_dir).select(line.alias("value")).write.text(path)
    good, bad = ingest.read_requests_checked(spark, path, POINTS)
    total = rounded(F.aggregate("spectrum", F.lit(0.0), lambda t, v: t + v), 5)
    # A broken line may hide its number from the schema; its text still has it.
    number = F.regexp_extract("line", r'"request_id": ?([0-9]+)', 1).cast("long")
    kept = good.select("request_id", total.alias("total"), F.lit(None).cast("string").alias("reason"))
    return kept.unionAll(bad.select(F.coalesce("request_id", number).alias("request_id"), F.lit(None).cast("double").alias("total"), "reason"))


@query(
    "pad_truncate",
    f"""SELECT vec_id, CAST(100 AS BIGINT) AS n_padded, {sql_round('list_sum(s)')} AS padded_sum,
              CAST(0.0 AS DOUBLE) AS padded_last, CAST(40 AS BIGINT) AS n_cut, {sql_round('s[40]')} AS cut_last
       FROM {SQL_SPECTRA}""",
)
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spectra(spark, sf_dir)
    longer, shorter = arrays.pad_or_truncate(F.col("spectrum"), 100), arrays.pad_or_truncate(F.col("spectrum"), 40)
    return table.select("vec_id", longer.alias("longer"), shorter.alias("shorter")).select(
        "vec_id",
        F.size("longer").cast("long").alias("n_padded"),
        rounded(F.aggregate("longer", F.lit(0.0), lambda t, v: t + v)).alias("padded_sum"),
        F.element_at("longer", -1).alias("padded_last"),
        F.size("shorter").cast("long").alias("n_cut"),
        rounded(F.element_at("shorter", -1)).alias("cut_last"),
    )


@query(
    "network_inputs",
    f"""SELECT vec_id, CAST(4 AS BIGINT) AS n_process, CAST(80 AS BIGINT) AS n_spectral,
              {sql_round('list_sum([CASE WHEN x < -0.2 THEN 0.0 ELSE x END FOR x IN s[1:4]])')} AS process_sum,
              {sql_round('list_sum(s[5:64])')} AS spectral_sum
       FROM {SQL_SPECTRA}""",
)
def network_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process block (with gaps) and padded spectrum as the two inputs of a hybrid model."""
    gaps = F.transform(F.slice("spectrum", 1, 4), lambda v: F.when(v >= -0.2, v))
    table = spectra(spark, sf_dir).select(
        "vec_id", gaps.alias("process"), arrays.position_slice(F.col("spectrum"), 4, POINTS).alias("spectrum")
    )
    pair = spectral.network_inputs(table, "process", "spectrum", 80)
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda t, v: t + v))
    return pair.select(
        "vec_id",
        F.size("process").cast("long").alias("n_process"),
        F.size("spectrum").cast("long").alias("n_spectral"),
        total("process").alias("process_sum"),
        total("spectrum").alias("spectral_sum"),
    )


@query(
    "fill_missing",
    """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount = 0.05 THEN 0.0 ELSE l_discount END AS l_discount,
              CASE WHEN l_tax = 0.03 THEN 0.0 ELSE l_tax END AS l_tax
       FROM lineitem""",
)
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = lineitem(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.nullif("l_discount", F.lit(0.05)).alias("l_discount"),
        F.when(F.col("l_tax") == 0.03, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("l_tax"),
    )
    return cleaning.fill_missing(gaps)


@query(
    "fill_missing_subset",
    f"""SELECT vec_id, CAST(CASE WHEN label = 3 THEN 0 ELSE label END AS INTEGER) AS label,
              CAST(len([1 FOR x IN s IF x < 0]) AS BIGINT) AS n_gaps
       FROM {SQL_SPECTRA}""",
)
def fill_missing_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps are filled in the process columns and stay in the spectral ones."""
    wide = wide_spectra(spark, sf_dir)
    names = [c for c in wide.columns if c[0].isdigit()]
    gaps = wide.select(
        "vec_id",
        F.nullif("label", F.lit(3)).alias("label"),
        *[F.when(F.col(f"`{n}`") >= 0, F.col(f"`{n}`")).alias(n) for n in names],
    )
    filled = cleaning.fill_missing_process(gaps)
    missing = F.size(F.filter(F.array(*[f"`{n}`" for n in names]), lambda v: v.isNull()))
    return filled.select("vec_id", "label", missing.cast("long").alias("n_gaps"))


@query(
    "coerce_numeric",
    """SELECT event_id, CASE WHEN event_type = 'error' OR event_type = 'view' THEN 0.0
                             WHEN event_type = 'signup' THEN round(value * 100.0, 6)
                             ELSE round(value, 6) END AS reading
       FROM events""",
)
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text: plain, padded, with exponent, and two kinds of garbage."""
    kind = F.col("event_type")
    text = F.col("value").cast("string")
    cents = F.format_string("%d", F.bround(F.col("value") * 100).cast("long"))
    reading = (
        F.when(kind == "error", "sensor fault")
        .when(kind == "view", F.concat(text, F.lit("d")))
        .when(kind == "signup", F.concat(cents, F.lit("e0")))
        .otherwise(F.concat(F.lit(" "), text))
    )
    events = tables.read_parquet(spark, sf_dir, "events").select("event_id", reading.alias("reading"))
    coerced = cleaning.coerce_numeric(events)
    return coerced.select("event_id", rounded(F.col("reading"), 6).alias("reading"))


@query(
    "clean_nonfinite",
    f"""SELECT vec_id, CAST(len([1 FOR x IN s IF abs(x) > 0.2]) AS BIGINT) AS n_replaced,
              {sql_round('list_sum([CASE WHEN abs(x) > 0.2 THEN 0.0 ELSE x END FOR x IN s])')} AS total
       FROM {SQL_SPECTRA}""",
)
def clean_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.transform(
        "spectrum",
        lambda v: F.when(v > 0.3, F.lit(float("inf")))
        .when(v > 0.2, F.lit(float("nan")))
        .when(v < -0.2, F.lit(float("-inf")))
        .otherwise(v),
    )
    cleaned = cleaning.clean_nonfinite(spectra(spark, sf_dir).withColumn("spectrum", broken), "spectrum")
    total = F.aggregate("spectrum", F.lit(0.0), lambda t, v: t + v)
    return cleaned.select("vec_id", "n_replaced", rounded(total).alias("total"))


@query("nonzero_spectra", "SELECT vec_id, label FROM embeddings WHERE label <> 3")
def nonzero_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    dark = F.when(F.col("label") == 3, F.array_repeat(F.lit(0.0), POINTS)).otherwise(F.col("spectrum"))
    return cleaning.drop_all_zero(spectra(spark, sf_dir).withColumn("spectrum", dark), "spectrum").select("vec_id", "label")


@query(
    "spectrum_quality",
    f"""SELECT vec_id, CAST(len([1 FOR x IN t IF x <> 0]) AS BIGINT) AS n_nonzero,
              CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct,
              len([1 FOR x IN t IF x <> 0]) > 0 AND len(list_distinct(t)) > 1 AS usable
       FROM (SELECT vec_id, [CASE WHEN label = 3 THEN 1.0 WHEN abs(x) < 0.1 THEN 0.0 ELSE x END FOR x IN s] AS t
             FROM {SQL_SPECTRA})""",
)
def spectrum_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.when(F.col("label") == 3, F.array_repeat(F.lit(1.0), POINTS)).otherwise(
        F.transform("spectrum", lambda v: F.when(F.abs(v) < 0.1, F.lit(0.0)).otherwise(v))
    )
    rated = cleaning.spectrum_quality(spectra(spark, sf_dir).withColumn("spectrum", flat), "spectrum")
    return rated.select("vec_id", "n_nonzero", "n_distinct", "usable")


@query(
    "validate_length",
    f"""SELECT vec_id, CASE WHEN label = 7 THEN 'Spectrum ' || vec_id || ' has 60 values, expected 64' END AS reason
        FROM {SQL_SPECTRA}""",
)
def validate_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("label") == 7, F.slice("spectrum", 1, 60)).otherwise(F.col("spectrum"))
    table = spectra(spark, sf_dir).withColumn("spectrum", short)
    return cleaning.validate_length(table, "vec_id", "spectrum", POINTS).select("vec_id", "reason")


def _long(df: DataFrame, axis: list[float]) -> DataFrame:
    long = spectral.to_long(df, ["vec_id"], "spectrum", axis)
    return long.withColumn("intensity", rounded(F.col("intensity"), 9))
