"""Every corpus query and the pipeline on executors that have no copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

JOB = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
# the driver alone sees the package: workers are started before its folder is on the path
def lookup(batches):
    import importlib.util
    for batch in batches:
        if importlib.util.find_spec("veilspan"):
            raise AssertionError("the workers see the package")
        yield batch
spark.range(4).mapInArrow(lookup, "id long").collect()
sys.path.insert(0, {root!r})
import corpus_pipeline
from veilspan.llm import queries
for name, query in {{**queries.QUERIES, "pipeline": corpus_pipeline.run}}.items():
    try:
        query(spark, {folder!r}).write.format("noop").mode("overwrite").save()
    except Exception as wrong:
        print("failed", name, str(wrong)[-300:])
print("done")
"""


def test_workers_need_no_package(folder, tmp_path):
    run = subprocess.run([sys.executable, "-c", JOB.format(root=ROOT, folder=folder)], cwd=tmp_path, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "failed" not in run.stdout and run.stdout.rstrip().endswith("done"), run.stdout + run.stderr[-2000:]
