"""A plain session started outside the repository (as the driver's check does) can
run operators whose tasks execute Python: the package is shipped to the workers."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "America/Los_Angeles").getOrCreate())
import __spark_entry__ as E
n = E.queries()["extract_pages"](spark, "/root/testdata/sf0.001").count()
m = E.queries()["annotate_comments"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n, m)
"""


def test_plain_session_outside_repo():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.mkdtemp(), env=env,
                         capture_output=True, text=True, timeout=600)
    line = [ln for ln in out.stdout.splitlines() if ln.startswith("ROWS")]
    assert line, out.stderr[-2000:]
    _, n, m = line[0].split()
    assert int(n) > 0 and int(m) > 0
