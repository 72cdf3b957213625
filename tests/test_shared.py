"""Staging where the environment names no shared folder."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
from pyspark.sql import SparkSession
from sluice.sources import shared
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
a = shared.staged(spark.range(7), "a")
assert a.count() == 7 and shared.shared_dir(spark) == shared.shared_dir(spark) and a.staged_at.startswith(shared.shared_dir(spark))
spark.range(3).checkpoint()
print("staged")
"""


def test_staging_without_a_configured_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=240)
    assert "staged" in done.stdout, done.stderr[-2000:]
