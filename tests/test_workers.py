"""Python functions of the engine where workers cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, REPO)
from pyspark.sql import functions as F
from tallyline.functions import scalars as sc

blob = F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256))
for r in spark.range(3).select(blob.alias("b"), sc.encode_contract(blob).alias("c")).collect():
    assert r["c"] == sc.checked_id(bytes(r["b"])), r
try:
    spark.range(1).select(sc.encode_contract(F.lit(b"short"))).collect()
except Exception as e:
    assert "an identifier has 32 bytes" in str(e), e
else:
    raise SystemExit("a short identifier passed")
print("workers ok")
"""


def test_workers_need_no_package(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.replace("REPO", repr(repo))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "workers ok" in out.stdout, out.stdout + out.stderr[-3000:]
