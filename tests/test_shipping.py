"""Kernels reach Python workers that don't have the package on their path."""

import os
import subprocess
import sys

from tests.conftest import ROOT

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
queries = __spark_entry__.queries()
print([queries[n](spark, sys.argv[2]).count() for n in ("advancing_front_area", "stream_borders")])
"""


def test_from_another_folder(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE, ROOT, sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip().endswith("[4, 128]"), out.stderr[-2000:]
