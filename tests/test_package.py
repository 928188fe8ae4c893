"""Workers that were started elsewhere find the package."""

import os
import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("contract", "{ROOT}/__spark_entry__.py")
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", contract.queries()["cv_metrics"](spark, "/root/testdata/sf0.001").count())
"""


def test_arrow_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows 9" in done.stdout, done.stderr[-2000:]


def test_the_library_stands_without_its_optional_part():
    for source in (ROOT / "spectrabatch").rglob("*.py"):
        if "llm" not in source.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", source.read_text()), source
