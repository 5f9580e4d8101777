"""Kept days with sketches, results in pages, reports that know whether they are whole, counts taken while writing."""

import tempfile
import threading
import time
from datetime import date

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from visitflow.operators import daily, kpis, quality
from visitflow.plans.adhoc import SqlResult, run_sql
from visitflow.plans.report import read_manifest, write_sections
from visitflow.sources.star import visits


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    df = visits(spark, sf_dir).persist()
    yield df
    df.unpersist()


def test_all_days_give_the_headline_numbers(table):
    whole, days = kpis.kpi_row(table).first(), daily.kpis_of_days(daily.daily_measures(table)).first()
    for name in whole.asDict():
        assert days[name] == (pytest.approx(whole[name]) if isinstance(whole[name], float) else whole[name])
    n = table.select("patient_id").distinct().count()
    assert abs(days["unique_patients"] - n) <= 0.02 * n


def test_a_range_reads_kept_days_only(spark, table, folder):
    target = folder + "/days"
    daily.write_daily(table, target)
    days = daily.read_daily(spark, target)
    first, last = date(1996, 2, 10), date(1997, 5, 3)
    inside = table.where(F.col("admission_date").between(first, last))
    row, want = daily.kpis_of_days(days, first, last).first(), kpis.kpi_row(inside).first()
    assert row["total_patients"] == want["total_patients"] == inside.count() > 0
    assert row["date_range_start"] == want["date_range_start"]
    assert row["avg_wait_time"] == pytest.approx(want["avg_wait_time"])
    n = inside.select("patient_id").distinct().count()
    assert abs(row["unique_patients"] - n) <= 0.02 * n
    assert daily.kpis_of_days(days, last, first).first()["total_patients"] == 0


@pytest.mark.parametrize("bits", [10, 14])
def test_merged_sketches_keep_their_error(spark, bits):
    """Ids that return on many days: sums of daily counts would be far off, merged sketches are not."""
    n = 200_000
    rows = spark.range(4 * n).select(
        F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") % 97).cast("int")).alias("admission_date"),
        F.format_string("P%09d", F.col("id") % n).alias("patient_id"), F.lit(True).alias("is_admitted"),
        F.lit(5).alias("wait_time"), F.lit(None).cast("double").alias("satisfaction_score"), F.lit("Male").alias("gender"),
        F.lit("A").alias("department_referral"),
    )
    row = daily.kpis_of_days(daily.daily_measures(rows, bits)).first()
    assert row["total_patients"] == 4 * n and row["unique_departments"] == 1
    assert abs(row["unique_patients"] - n) <= 4 * 1.04 / 2 ** (bits / 2) * n


def test_pages_hold_all_rows_in_order(table):
    result = run_sql(table, "SELECT patient_id, wait_time FROM patients ORDER BY patient_id")
    pages = list(result.pages(400))
    assert [len(p) for p in pages[:-1]] == [400] * (len(pages) - 1) and 0 < len(pages[-1]) <= 400
    rows = [r["patient_id"] for page in pages for r in page]
    assert rows == sorted(rows) and len(rows) == table.count()
    assert list(SqlResult().pages()) == [] and list(run_sql(table, "SELECT * FROM patients WHERE false").pages()) == []


def test_pages_of_ten_million_rows_are_fetched_as_asked_for(spark, table):
    result = run_sql(table, "SELECT id, id * 2 AS twice FROM range(0, 10000000, 1, 64)")
    total, at = 0, time.perf_counter()
    for page in result.pages(100_000):
        total += len(page)
        if total == 500_000:
            break
    assert total == 500_000 and page[-1]["id"] == 499_999
    assert time.perf_counter() - at < 60  # four of 64 partitions


def test_paging_can_be_ended(table):
    result = run_sql(table, "SELECT id FROM range(0, 8, 1, 8) WHERE id < 1 OR "
                            "(SELECT count(*) FROM range(0, 400000, 1, 4) a JOIN range(0, 400000, 1, 4) b "
                            "ON a.id % 3 = b.id % 3 AND sqrt(a.id * b.id) < -1) > 0")
    timer = threading.Timer(4, result.cancel)
    timer.start()
    list(result.pages())
    assert result.error.startswith("cancelled")
    timer.join()


def test_errors_while_paging_become_text(table):
    result = run_sql(table, "SELECT assert_true(wait_time < 0) FROM patients")
    assert list(result.pages()) == [] and result.data is None and "wait_time" in result.error


def test_a_running_statement_can_be_ended(spark, table):
    result = run_sql(table, "SELECT count(*) AS n FROM range(0, 400000, 1, 4) a JOIN range(0, 400000, 1, 4) b "
                            "ON a.id % 3 = b.id % 3 AND sqrt(a.id * b.id) < -1")
    timer = threading.Timer(4, result.cancel)
    timer.start()
    at = time.perf_counter()
    assert result.execute() == [] and result.error.startswith("cancelled")
    assert time.perf_counter() - at < 60
    timer.join()
    other = run_sql(table, "SELECT count(*) AS n FROM patients")
    assert other.execute()[0]["n"] == table.count() and other.error is None


def test_a_report_that_breaks_off_is_recognised(spark, table, folder):
    good = {"one": table.select("age").limit(7), "two": table.groupBy("gender").count().orderBy("gender")}
    rows = write_sections(good, folder)
    assert rows == read_manifest(spark, folder) == {"one": 7, "two": table.select("gender").distinct().count()}
    bad = {"one": table.select("age").limit(3), "two": table.select(F.raise_error(F.lit("broken")).alias("x"))}
    with pytest.raises(Exception, match="broken"):
        write_sections(bad, folder)
    assert read_manifest(spark, folder) is None
    write_sections(good, folder, "csv")
    assert read_manifest(spark, folder) == rows
    assert read_manifest(spark, folder + "/nowhere") is None


def test_rules_are_counted_while_rows_are_written(spark, table, folder):
    seen = Observation("rules")
    quality.observed(table, seen).write.parquet(folder + "/t")
    want = {r["rule"]: r["violations"] for r in quality.summary(table).collect()}
    found = {r["rule"]: r["violations"] for r in quality.summary_of(seen.get, spark.read.parquet(folder + "/t")).collect()}
    assert found == want
