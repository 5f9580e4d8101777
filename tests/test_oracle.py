"""Every registered query with a SQL twin, against DuckDB on the same tables."""

import re

import compare
import pytest

import __spark_entry__ as entry_module
from oracle_queries import ORACLE
from orders import ORDER

QUERIES = entry_module.queries()

# Iterative models and p-values have no SQL form; their own tests cover them.
WITHOUT_SQL = {
    "admission_model_metrics", "admission_model_report",
    "admission_importances", "score_model_metrics", "score_importances", "patient_segments_drawn", "segment_scatter_drawn",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_result(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir)
    assert _sorts(frame) == (name in ORDER)
    assert compare.differences(frame, con, ORACLE[name], ORDER.get(name)) == []


def _sorts(frame) -> bool:
    """Is the result of the plan a sorted one?"""
    for line in frame._jdf.queryExecution().analyzed().toString().split("\n"):
        node = line.lstrip(" +:-")
        if not node.startswith(("Project", "GlobalLimit", "LocalLimit", "SubqueryAlias")):
            return node.startswith("Sort") and node.endswith("true")
    return False


def test_every_query_has_a_twin_or_a_reason():
    visits = {name for name in QUERIES if not re.match(r"op\d+_|pipeline$", name)}  # the others have their own tests
    assert visits - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).columns == [
        "department", "patient_count", "admission_rate_pct", "avg_wait_min", "avg_satisfaction",
    ]
