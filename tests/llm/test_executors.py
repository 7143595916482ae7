"""Every query of the subpackage and the pipeline where Python workers have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent

RUN = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver alone finds the package
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "2g").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
import corpus_pipeline
from lodestar.llm import queries
def found(rows):
    import importlib.util
    return iter([importlib.util.find_spec("lodestar") is not None for _ in rows][:1])
assert not any(spark.sparkContext.parallelize([1], 1).mapPartitions(found).collect()), "the workers find the package"
for name, f in [*queries.queries().items(), ("pipeline", corpus_pipeline.run)]:
    print(name, f(spark, sys.argv[2]).count(), flush=True)
"""


def test_executors_need_no_copy_of_the_package(tmp_path, small):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-B", "-c", RUN, str(REPO), small], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert len(counts) >= 11 and counts.pop("pipeline") != "0"
    assert all(int(n) > 0 for n in counts.values())
