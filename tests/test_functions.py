"""Columns and schema rules on small tables with the awkward values."""

import math

import pytest
from pyspark.sql import functions as F

from spectrabatch.functions import arrays, names, numeric
from spectrabatch.operators import cleaning, schema

INF, NAN = float("inf"), float("nan")


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_coerce_number(spark):
    texts = ["1.5", " 12 ", "-3e2", ".5", "7.", "1.5d", "0x1p3", "abc", "", None, "inf", "-Infinity", "nan", "1_000"]
    got = column(spark, texts, "string", numeric.coerce_number)
    assert got == [1.5, 12.0, -300.0, 0.5, 7.0, 0, 0, 0, 0, 0, INF, -INF, 0, 0]


def test_missing_and_nonfinite(spark):
    values = [1.0, None, NAN, INF, -INF, 0.0]
    assert column(spark, values, "double", numeric.missing_to_zero) == [1.0, 0.0, 0.0, INF, -INF, 0.0]
    assert column(spark, values, "double", numeric.finite_or_zero) == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_rounding_half_even_on_doubles(spark):
    values = [8.155, 0.125, 0.375, 2.5, -0.001]
    assert column(spark, values, "double", numeric.rounded_half_even) == [8.15, 0.12, 0.38, 2.5, 0.0]


def test_bins_agree_with_edges(spark):
    low, high, bins = 0.1, 0.7, 6
    edges = numeric.bin_edges(low, high, bins)
    values = edges + [math.nextafter(e, -1) for e in edges[1:]] + [0.33, 0.0, 0.9]
    got = column(spark, values, "double", lambda v: numeric.half_open_bin(v, low, high, bins))
    for value, bin_number in zip(values, got):
        inner = [low + i * ((high - low) / bins) for i in range(bins)] + [high]
        assert bin_number == sum(value >= e for e in inner)
    closed = column(spark, values, "double", lambda v: numeric.closed_bin(v, low, high, bins))
    assert max(closed) == bins and min(closed) == 1


def test_bins_of_constant_and_null(spark):
    got = column(spark, [2.0, None], "double", lambda v: numeric.closed_bin(v, 2.0, 2.0, 5))
    assert got == [1, None]


def test_confidence_band_limits(spark):
    values = [-0.01, 0.0, 40.0, 40.01, 60.0, 60.01]
    assert column(spark, values, "double", numeric.confidence_band) == ["low", "high", "high", "medium", "medium", "low"]


def test_hours_do_not_depend_on_time_zone(spark):
    sql = "SELECT timestamp_ntz'2024-03-31 00:00:00' AS a, timestamp_ntz'2024-03-31 12:00:00' AS b"
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert spark.sql(sql).select(numeric.hours_between(F.col("a"), F.col("b"))).first()[0] == 12.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_pad_or_truncate(spark):
    got = column(spark, [[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]], "array<double>", lambda v: arrays.pad_or_truncate(v, 3))
    assert got == [[1.0, 2.0, 0.0], [1.0, 2.0, 3.0]]


def test_axis_range_is_inclusive_and_by_value():
    assert arrays.axis_range([201.0, 350.0, 351.0, 1750.0, 1751.0], 350, 1750) == (1, 4)
    assert arrays.axis_range([1.0, 2.0], 350, 1750) == (0, 0)
    with pytest.raises(ValueError):
        arrays.axis_range([3.0, 1.0], 0, 5)


def test_sort_by_axis(spark):
    assert column(spark, [[3.0, 1.0, 2.0]], "array<double>", lambda v: arrays.sort_by_axis(v, [9, 7, 8])) == [[1.0, 2.0, 3.0]]


def test_spectral_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "x", 5)], "`200.5` double, `2400` double, pH double, `300` string, n int")
    assert names.spectral_columns(df) == ["200.5", "2400"]
    assert names.process_columns(df) == ["pH", "300", "n"]


def test_plain_names_are_unique():
    assert names.plain_names(["Time (h)", "time h", "2400", "DO(%)"]) == {
        "Time (h)": "time_h", "time h": "time_h_2", "2400": "c_2400", "DO(%)": "do",
    }


def test_schema_operators(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, pH double, `2400` double, `200.5` double")
    left, right = schema.split_at(df, "2400")
    assert left.columns == ["id", "pH"] and right.columns == ["2400", "200.5"]
    swapped = schema.swap_columns(df, "id", "pH")
    assert swapped.columns == ["pH", "id", "2400", "200.5"] and swapped.first()["id"] == 2.0
    assert schema.require_columns(df, ["200.5", "id"]).columns == ["200.5", "id"]
    with pytest.raises(schema.SchemaContractError, match="temperature"):
        schema.require_columns(df, ["id", "temperature"])
    assert schema.reindex(df, ["id", "absent"]).first().asDict() == {"id": 1, "absent": 0.0}
    assert schema.overview(df, target="pH").first().asDict() == {
        "n_rows": 1, "n_columns": 4, "n_process": 1, "n_spectral": 2,
    }


def test_cleaning(spark):
    df = spark.createDataFrame([(None, NAN, None, "x")], "pH double, temp double, `350` double, note string")
    assert cleaning.fill_missing(df).first()[:3] == (0.0, 0.0, 0.0)
    kept = cleaning.fill_missing_process(df).first()
    assert kept["pH"] == 0.0 and kept["350"] is None

    spectra = spark.createDataFrame(
        [(1, [1.0, NAN, INF]), (2, [0.0, 0.0, 0.0]), (3, [1.0]), (4, None)], "id int, s array<double>"
    )
    cleaned = {r["id"]: r for r in cleaning.clean_nonfinite(spectra, "s").collect()}
    assert cleaned[1]["s"] == [1.0, 0.0, 0.0] and cleaned[1]["n_replaced"] == 2
    assert [r["id"] for r in cleaning.drop_all_zero(spectra.where("id < 3"), "s").collect()] == [1]
    checked = cleaning.validate_length(spectra, "id", "s", 3)
    valid, rejected = cleaning.split_valid(checked)
    assert sorted(r["id"] for r in valid.collect()) == [1, 2]
    reasons = {r["id"]: r["reason"] for r in rejected.collect()}
    assert reasons == {3: "Spectrum 3 has 1 values, expected 3", 4: "Spectrum 4 has 0 values, expected 3"}


def test_row_slice_plans_agree(spark, monkeypatch):
    df = spark.range(300).selectExpr("id * 3 AS id").repartition(4)
    short = [r[0] for r in schema.row_slice(df, "id", 10, 25).orderBy("id").collect()]
    monkeypatch.setattr(schema, "SHORT_HEAD", 5)
    deep = [r[0] for r in schema.row_slice(df, "id", 10, 25).orderBy("id").collect()]
    assert short == deep == [3 * i for i in range(10, 25)]
    for stop in (3, 300):
        with pytest.raises(TypeError):
            schema.row_slice(df.selectExpr("string(id) AS id"), "id", 0, stop)
