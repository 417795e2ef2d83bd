"""Every query of the corpus operators against its SQL twin; the package is optional."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry_points
from compare import connect, differences
from conftest import ROOT, SF
from revpulse.llm.queries import ORACLE_SQL, QUERIES


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    known = entry_points.queries()
    assert set(QUERIES) | {"pipeline"} <= set(known) and set(ORACLE_SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_twin(spark, name):
    frame = entry_points.queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "BatchEvalPython" not in plan
    assert differences(frame, connect(SF), ORACLE_SQL[name]) == []


def test_the_rest_works_without_the_package(tmp_path):
    """In a copy without both folders and the pipeline."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    assert not (copy / "revpulse" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in {**q, **e.oracle_sql()})"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_rules.py", "-q"], cwd=copy, check=True, env=env, timeout=600)
