"""Queries that use Python functions where workers cannot import the package; the pipeline's stages call five operators more."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
try:
    spark.range(1).rdd.map(lambda _: __import__("tallyline")).count()
    raise SystemExit("workers can import the package: nothing is tested")
except Exception as e:
    assert "No module named" in str(e), e
sys.path.insert(0, REPO)
import __spark_entry__ as entry

for name in ("op2_rule_ledger", "op4_warc_segments", "op5_language_bitmask", "pipeline"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_workers_need_no_package(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.replace("REPO", repr(repo))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    got = dict(x.split() for x in out.stdout.splitlines() if len(x.split()) == 2)
    assert len(got) == 4 and all(int(n) for n in got.values()), out.stdout + out.stderr[-3000:]
