"""The driver contract works when __spark_entry__ is loaded by path from
another working directory (Python workers must still import the package)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(REPO, "__spark_entry__.py")!r})
mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(mod)
print("ENTRY", mod.entry(spark).count())
print("PAIRS", mod.queries()["similar_pairs"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_entry_loaded_by_path_from_elsewhere():
    work = tempfile.mkdtemp(prefix="ledgerlake-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    res = subprocess.run([sys.executable, "-c", SCRIPT], cwd=work, env=env, capture_output=True, text=True, timeout=600)
    assert "ENTRY 1" in res.stdout, res.stderr[-3000:]
    assert "PAIRS" in res.stdout, res.stderr[-3000:]
