"""Run functions one by one in sessions of their own, without the package on the workers' path: what a user's cluster has."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
HEAD = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

def session():
    s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    return s
"""


def run_alone(cases: dict[str, str]) -> None:
    """Each case is code with ``spark``; a new context has no file of the one before. Names of those that fail are raised."""
    parts = [HEAD.format(root=ROOT), "bad = []"]
    for name, code in cases.items():
        body = textwrap.indent(textwrap.dedent(code).strip(), "    ")
        parts.append(f"spark = session()\ntry:\n{body}\nexcept Exception as e:\n    bad.append(({name!r}, str(e)[-300:]))\nspark.stop()")
    parts.append("print('BAD', bad) if bad else print('ALL FINE')")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", "\n".join(parts)], env=env, cwd="/tmp", capture_output=True, text=True)
    assert "ALL FINE" in got.stdout, got.stdout[-2000:] + got.stderr[-2000:]
