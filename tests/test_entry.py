"""The entry module with and without the training-data part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys

import __spark_entry__ as e
from pyspark.sql import SparkSession

names = set(e.queries())
assert names == set(e.oracle_sql()) and len(names) > 80 and not any(n.startswith("op") or n == "pipeline" for n in names), names
if not sys.argv[1:]:
    sys.exit()
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("gone", [["gridlens/llm", "tests/llm", "corpus_pipeline.py"], ["gridlens/llm", "tests/llm"]])
def test_core_stays_without_the_llm_folders(tmp_path, gone):
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        if (there / name).is_dir():
            shutil.rmtree(there / name)
        else:
            (there / name).unlink(missing_ok=True)
    run = subprocess.run([sys.executable, "-c", SCRIPT, *(["run"] if len(gone) == 2 else [])], cwd=there, env=os.environ | {"PYTHONPATH": str(there)}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
