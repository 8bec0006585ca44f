"""Tasks must not need the package: a driver that stands in another folder, without PYTHONPATH."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
sys.path.insert(0, sys.argv[1])
import __spark_entry__
queries = __spark_entry__.queries()
for name in sys.argv[3:]:
    print(name, queries[name](spark, "/root/testdata/sf0.001").count())
"""

NAMES = [
    "op1_mixing", "op4_pii", "op5_simhash_near_dedup", "op8_toxicity", "op9_warc", "op10_language_id", "op11_spelling_variants", "op12_prefix_trie", "op13_suffix_array_dedup", "pipeline",
]


def test_queries_run_from_another_folder(tmp_path):
    repo = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, repo, str(tmp_path / "shared"), *NAMES], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert done.returncode == 0, done.stderr[-3000:]
    assert all(f"{name} " in done.stdout for name in NAMES)
