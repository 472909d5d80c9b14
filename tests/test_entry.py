"""The driver's entry points, with the corpus subpackage and without a library that it needs."""

import os
import subprocess
import sys

import __spark_entry__ as entry
from placewright import plans

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_of_the_plans_is_there():
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_a_missing_library_costs_the_corpus_queries_only():
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.plans.QUERIES), sorted(e.oracle_sql()) == sorted(e.plans.ORACLES))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "True"], done.stderr
