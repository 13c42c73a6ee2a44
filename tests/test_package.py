"""The library runs away from its folder: Python functions reach the workers by value."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["delaunay_triangles"](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    env = dict(os.environ)
    paths = [p for p in env.pop("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO]
    if paths:
        env["PYTHONPATH"] = os.pathsep.join(paths)
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=str(REPO))],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False,
    )
    assert "rows" in done.stdout, done.stderr[-2000:]
