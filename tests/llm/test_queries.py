"""Queries with a DuckDB twin; the others are held against brute force in their operators' tests."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from visitflow.llm import registry

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import compare  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_result_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    assert compare.differences(registry.QUERIES[name](spark, sf_dir), con, registry.ORACLE[name]) == []


def test_all_queries_are_registered():
    assert set(registry.QUERIES) < set(entry_module.queries()) and "pipeline" in entry_module.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
