"""Shapes of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from visitflow.operators import catalog, filters, kpis, stats
from visitflow.sources.star import visits

QUERIES = entry_module.queries()
# The optional text operators have tests of their own.
QUERIES = {name: query for name, query in QUERIES.items() if not re.match(r"op\d+_|pipeline$", name)}
MODELS = {n for n in QUERIES if n.startswith(("admission_model", "admission_imp", "score_model", "score_imp"))} | {
    "patient_segments", "segment_scatter", "patient_segments_drawn", "segment_scatter_drawn",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_no_products_and_windows_only_over_counts(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    for window in re.findall(r"Window \[.*", text):
        # Histogram prefixes, rows of one prefix, and label lists: bounded by construction.
        assert re.search(r"windowspecdefinition\((stratum|slot|feature|prefix|part|specifiedwindowframe)", window)
        assert re.search(r"sum\(n#\d+L\)|dense_rank", window)
    if name not in ("wait_t_test", "score_wait_correlation", "wait_t_statistic", "score_wait_pearson"):
        assert "Python" not in text and "ArrowEval" not in text


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(visits(spark, sf_dir, "wait_time").agg(F.avg("wait_time")))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    import tempfile

    from visitflow.sources.files import read_visits, write_parquet

    target = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/visits"
    write_parquet(visits(spark, sf_dir), target)
    return read_visits(spark, target, "parquet")


def test_filters_reach_the_scan(stored):
    text = plan(filters.long_wait_admitted(stored).select("patient_id"))
    assert "GreaterThan(wait_time,50)" in text and "EqualTo(admission_flag,Admission)" in text
    text = plan(filters.select_visits(stored, years=[1996, 1997]).select("patient_id"))
    assert re.search(r"PartitionFilters: \[[^]]*year#\d+ IN \(1996,1997\)", text)
    assert "GreaterThanOrEqual(admission_date,1996-01-01)" in text
    assert "LessThan(admission_date,1998-01-01)" in text


def test_years_reach_the_scan_of_the_orders(spark, sf_dir):
    text = plan(QUERIES["selected_visits"](spark, sf_dir))
    pushed = re.search(r"PushedFilters: \[([^]]*o_orderdate[^]]*)\]", text)[1]
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01" in pushed and "LessThan(o_orderdate,2000-01-01" in pushed


def test_work_by_id_on_a_bucketed_table_needs_no_exchange(spark, sf_dir):
    from visitflow.operators import quality
    from visitflow.sources.files import save_bucketed

    save_bucketed(visits(spark, sf_dir), "visits_by_id", 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.table("visits_by_id")
        found = stats.visits_of_anomalous_ids(table)
        main = plan(found).split("Subquery")[0]  # the bounds are a scalar of their own
        assert "SortMergeJoin" in main and "Exchange" not in main and "Bucketed: true" in main
        assert "Exchange" not in plan(quality.duplicate_ids(table))
        want = stats.visits_of_anomalous_ids(visits(spark, sf_dir, "patient_id", "wait_time"))
        assert sorted(r["patient_id"] for r in found.collect()) == sorted(r["patient_id"] for r in want.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE visits_by_id")


def test_months_outside_a_range_are_not_opened(spark, sf_dir):
    import tempfile
    from datetime import date

    from visitflow.operators import daily

    target = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/days"
    daily.write_daily(visits(spark, sf_dir), target)
    text = plan(daily.kpis_of_days(daily.read_daily(spark, target), date(1997, 3, 1), date(1997, 3, 31)))
    assert re.search(r"PartitionFilters: \[[^]]*year#\d+ \* 12", text)
    assert "patient_id" not in text and "GreaterThanOrEqual(admission_date,1997-03-01)" in text


def test_groups_are_combined_before_the_shuffle(stored):
    for df in (catalog.department_performance(stored), kpis.admission_rates(stored), stats.wait_summary(stored)):
        text = plan(df)
        scan = text.rindex("FileScan")
        last_exchange = text.rindex("Exchange hashpartitioning", 0, scan)
        assert "partial_" in text[last_exchange:scan]


def test_top_rows_need_no_full_sort(stored):
    assert "TakeOrderedAndProject" in plan(catalog.long_wait_alerts(stored))
