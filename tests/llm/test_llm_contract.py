"""The registered queries: SQL where there is any, shapes, the pipeline, and the guard."""

import shutil
import subprocess
import sys
from pathlib import Path

import llm_data
import oracle
import pytest

import corpus_pipeline
from spectrabatch.llm.queries import LLM_ORACLES, LLM_QUERIES
from spectrabatch.session import ship_package

ROOT = Path(corpus_pipeline.__file__).resolve().parent

#: Columns each query must return, by operator number.
CONTRACT = {
    1: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    2: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    3: "query_id rank vec_id score",
    4: "doc_id fingerprint component_id",
    5: "doc_id start n_tokens ids_crc32",
    6: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    7: "page_id host path rule verdict",
    8: "doc_id n_assign n_access n_hex base_sha256 spans",
    9: "doc_id size source_size target taken",
    10: "doc_id held_out score predicted",
    11: "doc_id n_bytes n_tokens over_limit",
    12: "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    13: "lang source part item value rank",
}


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    ship_package(spark)
    connection = oracle.connect(sf_dir)
    try:
        assert oracle.differences(LLM_QUERIES[name](spark, sf_dir), LLM_ORACLES[name], connection) == []
    finally:
        connection.close()


@pytest.mark.parametrize("number", sorted(CONTRACT))
def test_columns(spark, sf_dir, number):
    ship_package(spark)
    (name,) = [n for n in LLM_QUERIES if n.startswith(f"op{number}_")]
    assert set(CONTRACT[number].split()) <= set(LLM_QUERIES[name](spark, sf_dir).columns)


def test_stages_work_on_all_that_is_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        new = corpus_pipeline.stored(stage(spark, docs, sf_dir), "test-stage")
        kept = {r["doc_id"] for r in new.select("doc_id").collect()}
        assert kept <= ids and kept, name
        if name == "secrets":
            assert kept == ids and new.count() == docs.count()
        if name != "packing":
            assert new.dtypes == docs.dtypes, name
        docs, ids = new, kept
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("rows", [[], None])
def test_stages_take_hostile_and_empty_tables(spark, tmp_path, rows):
    spark.createDataFrame([(3 * i, 1, 0) for i in range(40)] + [(None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = llm_data.documents(spark, rows) if rows is None else llm_data.empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        new = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "test-stage")
        assert name == "packing" or new.columns == docs.columns
        assert rows is None or new.count() == 0
        if name != "packing":  # extra columns named like the operators' own keep their values
            assert new.filter(" or ".join(f"`{c}` <> '{c}'" for c in llm_data.EXTRA)).count() == 0
        docs = new


def test_the_rest_imports_without_this_part(tmp_path):
    shutil.copytree(ROOT / "spectrabatch", tmp_path / "spectrabatch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={"PATH": "/usr/bin:/bin"})
    assert "fine" in done.stdout, done.stderr
