"""What a session of several processes shows only: executors see no memory and no folder of the driver's but the shared one."""

import os
import subprocess
import sys

SCRIPT = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
for name in sys.argv[2:]:
    print("ROWS", name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def rows(tmp_path, *names):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": repo}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), *names], capture_output=True, text=True, timeout=300, env=env, cwd=tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
    return {line.split()[1]: int(line.split()[2]) for line in done.stdout.splitlines() if line.startswith("ROWS")}


def test_database(tmp_path):
    assert rows(tmp_path, "a7_database_count", "s17_s18_database_f4_e25") == {"a7_database_count": 1, "s17_s18_database_f4_e25": 2}
