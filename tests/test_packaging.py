"""The package works where PySpark is a zip and where workers do not have the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code: str, cwd) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_oracle_needs_no_spark_distribution(tmp_path):
    out = _run(f"""
import sys; sys.path.insert(0, {REPO!r})
import pyspark
pyspark.__file__ = "/nowhere/pyspark.zip/pyspark/__init__.py"
import __spark_entry__ as e
print("N", len(e.oracle_sql()))
""", tmp_path)
    assert int(out.split("N")[-1]) >= 51


def test_worker_functions_need_no_package_on_the_worker(tmp_path):
    out = _run(f"""
import sys; sys.path.insert(0, {REPO!r})
from pyspark import cloudpickle
from centwise.operators import notify
from centwise.streaming import crossings
import pickle, types
fs = [f for m in (notify, crossings) for f in vars(m).values()
      if isinstance(f, types.FunctionType) and f.__module__ == m.__name__]
data = cloudpickle.dumps(fs)
import subprocess
code = "import sys, pickle; from pyspark import cloudpickle; print(len(cloudpickle.loads(sys.stdin.buffer.read())), 'centwise' in sys.modules)"
done = subprocess.run([sys.executable, "-c", code], input=data, capture_output=True)
print("OUT", done.stdout.decode(), done.stderr.decode()[-500:])
""", tmp_path)
    assert "False" in out, out
