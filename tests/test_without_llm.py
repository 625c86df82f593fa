"""The library without the llm folders and corpus_pipeline.py."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q))"


RUN = """
import os, sys
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
assert e.entry(spark).count() > 0
for name in ("agg_kpi", "txt_clean", "ens_iou", "lid_identify"):
    assert e.queries()[name](spark, sys.argv[1]).count() > 0, name
spark.stop()
"""


@pytest.mark.parametrize("left_over", [False, True])
def test_the_rest_imports(tmp_path, left_over):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    if left_over:
        (copy / "parchment" / "llm" / "__pycache__").mkdir(parents=True)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    got = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, env=env, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr
    n, n_llm = map(int, got.stdout.split())
    assert n > 100 and n_llm == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables are not here")
def test_the_rest_runs(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    got = subprocess.run([sys.executable, "-c", RUN, "/root/testdata/sf0.001"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr[-3000:]


def test_other_import_errors_are_seen(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    folder = copy / "parchment" / "llm"
    folder.mkdir()
    (folder / "__init__.py").write_text("")
    (folder / "catalog.py").write_text("import no_such_module\n")
    env = {**os.environ, "PYTHONPATH": str(copy)}
    assert subprocess.run([sys.executable, "-c", COUNT], cwd=copy, env=env, capture_output=True).returncode != 0
