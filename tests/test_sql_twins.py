"""Every registered query against its SQL twin, and what its plan may not contain."""

import pytest

import __spark_entry__ as entry_points
from compare import connect, differences
from conftest import SF
from revpulse import registry

QUERIES = registry.QUERIES
TWINS = {name: sql for name, sql in entry_points.oracle_sql().items() if name in QUERIES}
WITHOUT_TWIN = {"score_windows"}  # a trained model's scores


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(TWINS) == WITHOUT_TWIN
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_twin(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    assert differences(frame, duck, TWINS[name]) == []
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonRDD"):
        assert unwanted not in plan


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
