"""Workers that do not have the package: another working folder, no PYTHONPATH."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
names = {names!r} or [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()] + ["pipeline"]
for name in names:
    print("ran", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


@pytest.mark.parametrize("names", [["op5_html", "op8_simhash", "op11_conversation_repair", "op13_prefix_trie"]])
def test_queries_run_without_the_package_on_the_path(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, names=names)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600,
    )
    ran = [line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran ")]
    assert ran == names, done.stderr[-2000:]
