"""Every query in Python workers that have run nothing before, as on a new executor."""

import json
import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import json
from pyspark.sql import SparkSession
from grove.llm.queries import QUERIES

spark = (SparkSession.builder.master("local[4]").config("spark.python.worker.reuse", "false").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
said = {}
for name, f in QUERIES.items():
    try:
        f(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    except Exception as x:
        said[name] = str(x)[:2000]
print("SAID" + json.dumps(said))
"""


def test_queries_in_new_workers():
    out = subprocess.run([sys.executable, "-c", RUN], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, check=True, timeout=1500).stdout
    assert json.loads(next(x for x in out.splitlines() if x.startswith("SAID"))[4:]) == {}
