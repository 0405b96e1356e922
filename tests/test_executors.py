"""The package reaches executors that share no path with it."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

DRIVER = """
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("__spark_entry__", "{root}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("dom_text", "score"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_another_working_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", DRIVER.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert ran.returncode == 0, ran.stderr[-1500:]
    counts = dict(line.split() for line in ran.stdout.splitlines() if line.startswith(("dom_text", "score")))
    assert set(counts) == {"dom_text", "score"} and all(int(n) > 0 for n in counts.values())
