"""Every query where the workers have no copy of the package on their path."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def seen(source):
    import importlib.util
    yield from ([importlib.util.find_spec("newsloom") is not None] for _ in source)

assert spark.sparkContext.parallelize([0], 1).mapPartitions(seen).collect() == [[False]]
from newsloom.llm import queries
for name, query in queries.queries().items():
    print(name, query(spark, {data!r}).count(), flush=True)
"""


def test_workers_without_the_package(tmp_path, sf_dir):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root, data=sf_dir)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900
    )
    assert run.returncode == 0, run.stderr[-3000:]
    assert [line.split()[0].split("_")[0] for line in run.stdout.splitlines() if line.startswith("op")] == [f"op{n}" for n in range(1, 14)]
