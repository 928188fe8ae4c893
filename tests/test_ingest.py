"""Dirty files lose no row and name each cause."""

import pytest
from pyspark.sql import types as T

from spectrabatch.sources import ingest

SCHEMA = T.StructType().add("id", "long").add("name", "string").add("200.5", "double").add("230", "double")


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_csv_rows_are_clean_or_explained(spark, tmp_path):
    write(tmp_path / "c", "a.csv", ["id,name,200.5,230", "1,a,1.5,2", '2,"b, c",,3', "3,d,x1,y1", "4,e,1.0", "5,f,1,2,3", "", "oops,g,1,2"])
    write(tmp_path / "c", "b.csv", ["id,name,200.5,230", "6,h,NaN,1e3", "id,name,200.5,230", '7,"say ""x""",1,2'])
    good, bad = ingest.read_samples_checked(spark, str(tmp_path / "c"), SCHEMA, "id")
    assert sorted(r["id"] for r in good.collect()) == [1, 2, 6, 7]
    assert {r["id"]: r["name"] for r in good.collect()}[7] == 'say "x"'
    found = {r["line"]: (r["id"], r["file"].rsplit("/", 1)[1], r["reason"]) for r in bad.collect()}
    assert found == {
        "3,d,x1,y1": (3, "a.csv", "200.5: 'x1' is no number; 230: 'y1' is no number"),
        "4,e,1.0": (4, "a.csv", "3 fields, expected 4"),
        "5,f,1,2,3": (5, "a.csv", "5 fields, expected 4"),
        "oops,g,1,2": (None, "a.csv", "id: 'oops' is no number"),
        "id,name,200.5,230": (None, "b.csv", "id: 'id' is no number"),
    }


@pytest.mark.parametrize("columns", [["id"], ["name"], ["200.5"]])
def test_the_columns_used_do_not_change_the_side(spark, tmp_path, columns):
    write(tmp_path / "c", "a.csv", ["id,name,200.5,230", "1,a,1.5,2", "3,d,1,y1", "4,e,1.0"])
    good, bad = ingest.read_samples_checked(spark, str(tmp_path / "c"), SCHEMA, "id")
    assert good.select(*[f"`{c}`" for c in columns]).count() == 1 and bad.select("reason").count() == 2 and bad.count() == 2


def test_many_broken_numbers_are_counted():
    names = ["a", "b", "c", "d", "e"]
    assert ingest._csv_reason("x,x,x,x,1", names, set(names)).endswith("c: 'x' is no number and 1 more")


def test_requests_are_clean_or_explained(spark, tmp_path):
    write(tmp_path / "r", "a.json", [
        '{"request_id": 1, "spectral_values": [1.0, 2]}',
        '{"request_id": 2, "spectral_values": [1.0]}',
        '{"request_id": 3}',
        '{"request_id": 4, "spectral_values": [1.0, "x"]}',
        '{"request_id": "five", "spectral_values": [1.0, 2.0]}',
        '{"request_id": 6, "spectral_values": [1.0,',
        '{"request_id": 7, "spectral_values": [1.0, null], "more": true}',
    ])
    good, bad = ingest.read_requests_checked(spark, str(tmp_path / "r"), 2)
    assert {r["request_id"]: r["spectrum"] for r in good.collect()} == {1: [1.0, 2.0], 7: [1.0, None]}
    reasons = sorted(r["reason"] for r in bad.collect())
    assert [r for r in reasons if not r.startswith("no JSON")] == [
        "Spectrum 2 has 1 values, expected 2", "Spectrum 3 has 0 values, expected 2",
        "request_id is no whole number", "spectral_values[1] is no number",
    ]
    assert len(reasons) == 5 and all(r["file"].endswith("a.json") and r["line"] for r in bad.collect())
