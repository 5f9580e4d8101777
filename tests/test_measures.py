"""Grouped measures and SQL reports: null keys, rounding, empty categories, agreement of twin definitions."""

import pytest
from pyspark.sql import functions as F

from visitflow.operators import catalog, filters, kpis
from visitflow.plans.adhoc import preset, report_queries, run_sql
from visitflow.sources import schema as S
from visitflow.sources.star import visits


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_missing_keys_drop_out_of_frames_and_stay_in_reports(spark):
    df = spark.createDataFrame(
        [("F", "Admission", 1, 1.0), ("F", "Not Admission", 1, 1.0), (None, "Admission", 1, 1.0)],
        "gender string, admission_flag string, wait_time int, satisfaction_score double",
    ).withColumn("is_admitted", F.col("admission_flag") == "Admission")
    assert pairs(kpis.admission_rates(df, ["gender"]), "key", "admission_rate") == [("F", 50.0)]
    assert set(pairs(catalog.by_gender(df), "gender", "admission_rate_pct")) == {("F", 50.0), (None, 100.0)}


def test_age_groups_without_visits_count_zero(spark):
    df = spark.createDataFrame([("Teen (13-17)",)] * 2 + [(None,)], "age_group string")
    assert pairs(kpis.age_group_frequencies(df), "age_group", "n") == [
        (g, 2 if g == "Teen (13-17)" else 0) for g in S.AGE_GROUPS
    ]


def test_department_table_rounds_before_it_scales(spark):
    df = spark.range(300).select(
        F.lit("GP").alias("department_referral"), F.col("id").cast("string").alias("patient_id"),
        (F.col("id") < 149).alias("is_admitted"), F.lit(10).alias("wait_time"), F.lit(5.0).alias("satisfaction_score"),
        F.when(F.col("id") < 149, "Admission").otherwise("Not Admission").alias("admission_flag"),
    )
    assert kpis.department_table(df).first()["admission_rate"] == "50.0%"
    assert catalog.department_performance(df).first()["admission_rate_pct"] == 49.67


def test_yearly_table_without_scores(spark):
    df = spark.createDataFrame(
        [("A", 2020, True, 10, None), ("B", 2020, False, 15, None)],
        "patient_id string, year int, is_admitted boolean, wait_time int, satisfaction_score double",
    )
    assert tuple(kpis.yearly_table(df).first()) == (2020, 2, "50.0%", "12.5 min", "N/A")


def test_kpis_of_nothing(spark, sf_dir):
    none = visits(spark, sf_dir).where("year = 1800")
    assert filters.is_empty(none)
    row = kpis.kpi_row(none).first()
    assert row["total_patients"] == 0 and row["admission_rate"] is None
    assert catalog.volume_summary(none).first()["admission_rate_pct"] is None
    assert kpis.score_summary(none).first()["pct_scored"] is None


def test_orders(spark, sf_dir):
    v = visits(spark, sf_dir)
    days = [r["day_of_week"] for r in catalog.by_weekday(v).collect()]
    assert [d for d in days if d] == list(S.WEEKDAYS)
    groups = [r["age_group"] for r in catalog.by_age_group(v).collect()]
    assert [g for g in groups if g] == list(S.AGE_GROUPS)
    counts = [r["patient_count"] for r in catalog.department_performance(v).collect()]
    assert counts == sorted(counts, reverse=True)
    alerts = [(-r["wait_time"], r["patient_id"]) for r in catalog.long_wait_alerts(v).collect()]
    assert alerts == sorted(alerts) and len(alerts) == 50
    buckets = [r["wait_bucket"] for r in catalog.score_by_wait_bucket(v).collect()]
    assert buckets in (list(S.WAIT_BUCKETS), [S.WAIT_BUCKETS[-1], *S.WAIT_BUCKETS[:-1]])


def test_group_counts_add_up(spark, sf_dir):
    v = visits(spark, sf_dir)
    total = v.count()
    long = {}
    for r in kpis.frequencies(v).collect():
        long[r["dimension"]] = long.get(r["dimension"], 0) + r["n"]
    assert set(long.values()) == {total}
    rates = [r["admission_rate"] for r in kpis.admission_rates(v).collect()]
    assert all(0 <= r <= 100 for r in rates)


def test_results_do_not_depend_on_partitioning(spark, sf_dir):
    v = visits(spark, sf_dir)
    again = v.repartition(13, "wait_time")
    for query in (catalog.department_performance, catalog.low_score_groups, kpis.mean_scores):
        assert query(v).collect() == query(again).collect()


def test_filters_commute_and_empty_lists_match_nothing(spark, sf_dir):
    v = visits(spark, sf_dir)
    one = filters.low_scores(filters.long_wait_admitted(v)).select("patient_id")
    two = filters.long_wait_admitted(filters.low_scores(v)).select("patient_id")
    assert sorted(one.collect()) == sorted(two.collect())
    assert filters.select_visits(v, years=[]).isEmpty()
    known = v.where("year IS NOT NULL").count()
    assert filters.select_visits(v).count() == known
    parts = [filters.admission(v, s).count() for s in ("All", "Admitted Only", "Not Admitted Only")]
    assert parts[0] == parts[1] + parts[2]
    with pytest.raises(ValueError, match="admission status"):
        filters.admission(v, "Maybe")


def test_search(spark):
    df = spark.createDataFrame(
        [("A-1", "Smith"), ("b-2", None), (None, "SMYTHE"), ("AxB", "x")], "patient_id string, patient_name string"
    )
    assert pairs(filters.search(df, "sm"), "patient_name") == [("Smith",), ("SMYTHE",)]
    assert pairs(filters.search(df, "A.1"), "patient_id") == [("A-1",)]
    assert filters.search(df, "A.1", literal=True).isEmpty()
    assert filters.search(df, "").count() == 4


def test_run_sql(spark, sf_dir):
    v = visits(spark, sf_dir)
    good = run_sql(v, "SELECT count(*) AS n FROM patients WHERE is_admitted = 1 AND has_referral = 0;")
    expected = v.where("is_admitted AND NOT has_referral").count()
    assert good.error is None and good.data.first()["n"] == expected and good.rows() == 1
    assert "nowhere" in run_sql(v, "SELECT * FROM nowhere").error
    assert run_sql(v, "SELEC 1").error
    blank = run_sql(v, "  \n")
    assert blank.data is None and blank.error is None and blank.rows() == 0


def test_presets_and_report_queries(spark, sf_dir):
    v = visits(spark, sf_dir)
    assert set(catalog.PRESETS) == {
        "Patient Volume Summary", "Department Performance", "Admission Rate by Race", "Hourly Peak Analysis",
        "Monthly Volume Trend", "High Wait + Admitted",
    }
    assert preset(v, "Admission Rate by Race").columns == ["race", "total", "admitted", "admission_rate_pct"]
    assert len(catalog.LIBRARY) == 12
    results = report_queries(v)
    assert list(results) == list(catalog.REPORT)
    assert results["satisfaction_low_scorers"].count() <= 15


def test_views(spark, sf_dir):
    v = visits(spark, sf_dir)
    catalog.register_views(v)
    assert spark.sql("SELECT sum(total_patients) FROM dept_summary").first()[0] == v.count()
    assert spark.sql("SELECT sum(patient_count) FROM daily_volume").first()[0] == v.count()


def test_sql_text_can_only_query(spark, sf_dir):
    v = visits(spark, sf_dir, "wait_time", "is_admitted")
    spark.range(3).createOrReplaceTempView("other")
    for text in ("DROP VIEW other", "INSERT INTO other VALUES (1)", "CREATE TABLE t AS SELECT 1", "SELECT 1) ; DROP VIEW other"):
        assert run_sql(v, text).error
    assert spark.table("other").count() == 3
    broken = run_sql(v, "SELECT 1 / (wait_time - wait_time) AS x FROM patients")
    assert broken.error is None and broken.execute() == [] and "DIVIDE_BY_ZERO" in broken.error
    again = run_sql(v, "SELECT wait_time FROM patients WHERE 1 / (wait_time - wait_time) > 0")
    assert again.rows() == 0 and "DIVIDE_BY_ZERO" in again.error
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("patients")]
    spark.catalog.dropTempView("other")


def test_calls_in_parallel_keep_their_own_table(spark, sf_dir):
    from concurrent.futures import ThreadPoolExecutor

    v = visits(spark, sf_dir, "patient_id")
    parts = [v.limit(n) for n in range(1, 9)]
    with ThreadPoolExecutor(8) as pool:
        results = list(pool.map(lambda p: run_sql(p, "SELECT count(*) AS n FROM patients -- all"), parts))
    assert [r.execute()[0]["n"] for r in results] == list(range(1, 9))


def test_sql_text_keeps_its_order_and_own_names(spark, sf_dir):
    v = visits(spark, sf_dir, "patient_id", "wait_time")
    rows = run_sql(v, "WITH w AS (SELECT * FROM patients) SELECT patient_id FROM w ORDER BY patient_id DESC LIMIT 5;").execute()
    assert [r[0] for r in rows] == sorted((r[0] for r in rows), reverse=True) and len(rows) == 5
