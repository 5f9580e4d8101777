"""

Every query reads whole tables. Results whose floating-point sums depend on the order of addition are rounded on both
sides.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import date
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle_queries import CENTROIDS, ORACLE  # noqa: E402

from visitflow.operators import catalog, charts, daily, filters, kpis, learning, quality, sampling, stats  # noqa: E402
from visitflow.operators.derive import derive, parse, relabel_time_of_day  # noqa: E402
from visitflow.plans.adhoc import preset, report_queries, run_sql  # noqa: E402
from visitflow.sources.schema import BROWSE_COLUMNS  # noqa: E402
from visitflow.sources.star import raw_text, visits  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

_RATED = ("admission_flag", "wait_time", "satisfaction_score")
_ALERT = ("patient_id", "age", "gender", "race", "department_referral", "wait_time", "satisfaction_score",
          "admission_date", "admission_flag")
_LOW = ("race", "gender", "age_group", "department_referral", "wait_time", "satisfaction_score")
_MONTHS = ("year", "month", "month_name", "wait_time")
_HOURS = ("hour", "admission_flag", "wait_time")
_POINT = ("patient_id", "age", "wait_time")
_SHORT = {"unknown": "Unknown", "morning": "Morning", "afternoon": "Afternoon", "evening": "Evening", "night": "Night"}
_FEATURES = ("patient_id", *learning.FEATURES)
_SEGMENT = ("patient_id", *learning.SEGMENT_FEATURES)


def _on(operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    """An operator over the visit table, naming the columns it reads."""
    return lambda spark, path: operator(visits(spark, path, *columns))


def _rounded(operator: Callable[[DataFrame], DataFrame], digits: int, *names: str) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        out = operator(df)
        # Adding zero turns a negative zero into a plain one.
        return out.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})

    return run


def _raw_text_parsed(spark: SparkSession, path: str) -> DataFrame:
    parsed = parse(raw_text(spark, path, "patient_id", "admission_date", "admission_time"))
    return derive(parsed, only=("hour", "year", "month"))


def _sql(text: str) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        result = run_sql(df, text)
        if result.error:
            raise ValueError(result.error)
        return result.data

    return run


def _predicted(df: DataFrame) -> DataFrame:
    """Stand-in predictions that depend on the data only: long waits are predicted to be admitted."""
    guess = F.coalesce(F.col("wait_time"), F.lit(0)) > 30
    return df.select(F.col("is_admitted").cast("int").alias("label"), guess.cast("int").alias("prediction"))


def _predicted_scores(df: DataFrame) -> DataFrame:
    return filters.scored(df).select(
        F.col("satisfaction_score").alias("label"),
        (10 - F.coalesce(F.col("wait_time"), F.lit(0)) / 10.0).alias("prediction"),
    )


def _cluster_profiles(df: DataFrame) -> DataFrame:
    quadrant = F.col("is_admitted").cast("int") * 2 + F.col("has_referral").cast("int")
    return learning.cluster_profiles(df.withColumn("cluster", quadrant))


def _quarantined(df: DataFrame) -> DataFrame:
    bad = quality.check(df)[1]
    return bad.select("patient_id", F.concat_ws(",", quality.VIOLATIONS).alias("violations"))


def _order_ids(spark: SparkSession, path: str) -> DataFrame:
    """Order keys of line items read as ids: a table in which real ids repeat."""
    lines = spark.read.parquet(f"{path}/lineitem.parquet").select("l_orderkey")
    return quality.duplicate_ids(lines.select(F.expr("format_string('P%09d', l_orderkey)").alias("patient_id")))


def _departments_filled(spark: SparkSession, path: str) -> DataFrame:
    """Raw text in which one department is an empty field."""
    raw = raw_text(spark, path, "patient_id", "department_referral")
    return parse(raw.withColumn("department_referral", F.nullif("department_referral", F.lit("HOUSEHOLD"))))


def _quick_chart(df: DataFrame) -> DataFrame:
    counts = df.groupBy(F.col("department_referral").alias("department")).agg(F.count(F.lit(1)).alias("visits"))
    return charts.quick_chart(counts.orderBy(F.desc("visits"), "department"), 3)


def _assigned(df: DataFrame) -> DataFrame:
    points = df.where(F.col("wait_time").isNotNull()).withColumns({"x": F.col("age") / 10, "y": F.col("wait_time") / 10})
    return learning.nearest(points, CENTROIDS, ["x", "y"])


def _admission(pick: Callable[[learning.Trained], DataFrame], **options) -> Query:
    """A small result of the admission model; every call trains."""
    return lambda spark, path: pick(
        learning.train_admission(visits(spark, path, *_FEATURES, "is_admitted"), **options))


def _score(pick: Callable[[learning.Trained], DataFrame]) -> Query:
    return lambda spark, path: pick(learning.train_score(visits(spark, path, *_FEATURES, "satisfaction_score")))


_Q: dict[str, Query] = {
    # sources and derivations
    "visits_loaded": _on(lambda v: v),
    "raw_text_parsed": _raw_text_parsed,
    "sql_table": _on(
        _sql("SELECT department_referral, sum(is_admitted) AS admitted, sum(has_referral) AS referred "
             "FROM patients GROUP BY department_referral;"),
        "department_referral", "is_admitted", "has_referral",
    ),
    "dept_summary": _on(catalog.dept_summary, "department_referral", *_RATED),
    "daily_volume": _on(catalog.daily_volume, "admission_date", "wait_time"),
    # filters
    "selected_visits": _on(
        lambda v: filters.select_visits(
            v, [1996, 1997, 1999], ["Female", "Male"], ["BUILDING", "None"], "Admitted Only", "o_orderdate"
        ).drop("o_orderdate"),
        "patient_id", "o_orderdate", "year", "gender", "department_referral", "admission_flag",
    ),
    "not_admitted_visits": _on(
        lambda v: filters.admission(v, "Not Admitted Only"), "patient_id", "admission_flag"
    ),
    "filter_choices": _on(filters.choices, "year", "gender", "department_referral"),
    "long_wait_admitted": _on(
        lambda v: filters.long_wait_admitted(v).drop("admission_flag"), "patient_id", "wait_time", "admission_flag"
    ),
    "low_scores": _on(filters.low_scores, "patient_id", "satisfaction_score"),
    "visits_with_hour": _on(filters.with_hour, "patient_id", "hour"),
    "scored_visits": _on(filters.scored, "patient_id", "satisfaction_score"),
    "complete_visits": _on(
        lambda v: filters.complete(v, "satisfaction_score", "wait_time"),
        "patient_id", "satisfaction_score", "wait_time",
    ),
    "search_visits": _on(
        lambda v: filters.browse(v, "p0+1[0-9]*7$|#0+42$"), *BROWSE_COLUMNS, "patient_name"
    ),
    "search_literal": _on(
        lambda v: filters.search(v, "0042", literal=True), "patient_id", "patient_name"
    ),
    # SQL reports
    "volume_summary": _on(catalog.volume_summary, *_RATED),
    "department_performance": _on(catalog.department_performance, "department_referral", *_RATED),
    "equity_by_race": _on(catalog.LIBRARY["equity_by_race"], "race", *_RATED),
    "by_gender": _on(catalog.by_gender, "gender", *_RATED),
    "by_age_group": _on(catalog.by_age_group, "age_group", "age", "admission_flag", "wait_time"),
    "hourly": _on(catalog.hourly, *_HOURS),
    "hourly_with_unknown": _on(
        lambda v: catalog.hourly(v, known_hours_only=False).drop("admission_rate_pct"), *_HOURS
    ),
    "by_weekday": _on(catalog.by_weekday, "day_of_week", "wait_time", "satisfaction_score"),
    "monthly_trend": _on(catalog.monthly_trend, *_MONTHS),
    "long_wait_alerts": _on(catalog.long_wait_alerts, *_ALERT),
    "low_score_groups": _on(catalog.low_score_groups, *_LOW),
    "score_by_wait_bucket": _on(catalog.score_by_wait_bucket, "wait_time", "satisfaction_score"),
    "yearly": _on(catalog.yearly, "year", *_RATED),
    "preset_volume_summary": _on(lambda v: preset(v, "Patient Volume Summary"), *_RATED),
    "preset_department_performance": _on(
        lambda v: preset(v, "Department Performance"), "department_referral", *_RATED
    ),
    "preset_admission_rate_by_race": _on(lambda v: preset(v, "Admission Rate by Race"), "race", *_RATED),
    "preset_hourly_peak": _on(lambda v: preset(v, "Hourly Peak Analysis"), *_HOURS),
    "preset_monthly_trend": _on(lambda v: preset(v, "Monthly Volume Trend"), *_MONTHS),
    "preset_long_wait_admitted": _on(lambda v: preset(v, "High Wait + Admitted"), *_ALERT),
    "report_top_departments": _on(
        catalog.REPORT["top_departments_by_volume"], "department_referral", *_RATED
    ),
    "report_admission_rate_by_race": _on(catalog.REPORT["admission_rate_by_race"], "race", *_RATED),
    "report_hourly_peak": _on(catalog.REPORT["hourly_peak_analysis"], *_HOURS),
    "report_long_wait_admitted": _on(catalog.REPORT["high_wait_admitted_patients"], *_ALERT),
    "report_monthly_trend": _on(catalog.REPORT["monthly_volume_trend"], *_MONTHS),
    "report_low_scorers": lambda spark, path: report_queries(visits(spark, path))["satisfaction_low_scorers"],
    "sql_text": _on(
        _sql("SELECT time_of_day, count(*) AS visits, sum(CASE WHEN is_admitted = 1 THEN 1 ELSE 0 END) AS admitted, "
             "round(avg(wait_time), 2) AS avg_wait FROM patients GROUP BY time_of_day;"),
        "time_of_day", "is_admitted", "wait_time",
    ),
    # headline numbers and grouped measures
    "kpi_row": _on(
        kpis.kpi_row, "is_admitted", "wait_time", "satisfaction_score", "department_referral", "admission_date",
        "gender",
    ),
    "kpis_of_a_month": _on(
        lambda v: daily.kpis_of_days(daily.daily_measures(v), date(1997, 3, 1), date(1997, 3, 31)).drop("unique_patients"),
        "patient_id", "is_admitted", "wait_time", "satisfaction_score", "department_referral", "admission_date", "gender",
    ),
    "overall_admission_rate": _on(kpis.overall_admission_rate, "is_admitted"),
    "admission_rates": _on(kpis.admission_rates, *kpis.ADMISSION_DIMENSIONS, "is_admitted"),
    "mean_waits": _on(kpis.mean_waits, *kpis.WAIT_DIMENSIONS, "wait_time"),
    "score_summary": _on(_rounded(kpis.score_summary, 4, "mean", "std"), "satisfaction_score"),
    "mean_scores": _on(kpis.mean_scores, *kpis.SCORE_DIMENSIONS, "satisfaction_score"),
    "frequencies": _on(kpis.frequencies, *kpis.FREQUENCY_DIMENSIONS),
    "age_group_frequencies": _on(kpis.age_group_frequencies, "age_group"),
    "temporal_counts": _on(kpis.temporal_counts, *kpis.TIME_DIMENSIONS),
    "mean_wait_by_hour": _on(kpis.mean_wait_by_hour, "hour", "wait_time"),
    "yearly_table": _on(
        kpis.yearly_table, "year", "patient_id", "is_admitted", "wait_time", "satisfaction_score"
    ),
    "department_table": _on(
        kpis.department_table, "department_referral", "patient_id", "is_admitted", "wait_time", "satisfaction_score"
    ),
    # statistics
    "wait_summary": _on(_rounded(stats.wait_summary, 4, "mean", "std"), "wait_time"),
    "age_described": _on(stats.describe, "age"),
    "wait_t_statistic": _on(
        lambda v: stats.wait_t_test(v).select("t_stat", "df"), "is_admitted", "wait_time"
    ),
    "wait_t_test": _on(stats.wait_t_test, "is_admitted", "wait_time"),
    "score_wait_pearson": _on(
        lambda v: stats.score_wait_correlation(v).select("n", "pearson_r"), "satisfaction_score", "wait_time"
    ),
    "score_wait_correlation": _on(stats.score_wait_correlation, "satisfaction_score", "wait_time"),
    "trend": _on(
        _rounded(_rounded(stats.trend, 6, "slope"), 4, "intercept"), "satisfaction_score", "wait_time"
    ),
    "trend_line": _on(_rounded(stats.trend_line, 4, "wait_time", "score"), "satisfaction_score", "wait_time"),
    "wait_bounds": _on(stats.wait_bounds, "wait_time"),
    "anomalies": _on(stats.anomalies, "patient_id", "wait_time"),
    "anomaly_summary": _on(stats.anomaly_summary, "wait_time"),
    "anomaly_list": _on(
        stats.anomaly_list, "patient_id", "gender", "age", "race", "department_referral", "wait_time",
        "admission_flag",
    ),
    "anomaly_scatter": _on(stats.anomaly_scatter, "patient_id", "admission_date", "wait_time"),
    "visits_of_anomalous_ids": _on(stats.visits_of_anomalous_ids, "patient_id", "wait_time"),
    "profile": _on(stats.profile),
    # charts
    "chart_daily_volume": _on(charts.daily_volume, "admission_date"),
    "chart_admission_status": _on(charts.admission_status, "admission_flag"),
    "chart_monthly_volume": _on(charts.monthly_volume, "year", "month", "month_name"),
    "chart_gender": _on(charts.gender_counts, "gender"),
    "chart_race": _on(charts.race_counts, "race"),
    "chart_age_histogram": _on(charts.age_histogram, "age"),
    "chart_age_box": _on(charts.age_box, "age"),
    "chart_age_group_status": _on(charts.age_group_by_status, "age_group", "admission_flag"),
    "chart_department_counts": _on(charts.department_counts, "department_referral"),
    "chart_department_rates": _on(charts.department_rates, "department_referral", "is_admitted"),
    "chart_department_waits": _on(charts.department_waits, "department_referral", "wait_time"),
    "chart_wait_histogram": _on(charts.wait_histogram, "wait_time", "admission_flag"),
    "chart_wait_box": _on(charts.wait_box_by_weekday, "day_of_week", "wait_time"),
    "chart_wait_outliers": _on(charts.wait_outliers_by_weekday, "day_of_week", "wait_time"),
    "chart_weekday_hour_waits": _on(charts.weekday_hour_waits, "day_of_week", "hour", "wait_time"),
    "chart_wait_heatmap": _on(charts.wait_heatmap, "day_of_week", "hour", "wait_time"),
    "chart_score_histogram": _on(charts.score_histogram, "satisfaction_score"),
    "chart_score_by_race": _on(charts.score_by_race, "race", "satisfaction_score"),
    "chart_score_wait_points": _on(
        charts.score_wait_points, "wait_time", "satisfaction_score", "admission_flag"
    ),
    "chart_score_wait_visits": _on(
        charts.score_wait_visits, "patient_id", "wait_time", "satisfaction_score", "admission_flag"
    ),
    "chart_score_density": _on(
        _rounded(charts.score_density_by_age_group, 4, "satisfaction_score", "density"),
        "age_group", "satisfaction_score",
    ),
    "chart_score_box": _on(charts.score_box_by_age_group, "age_group", "satisfaction_score"),
    "chart_score_outliers": _on(charts.score_outliers_by_age_group, "age_group", "satisfaction_score"),
    "chart_hourly_volume": _on(charts.hourly_volume, "hour"),
    "chart_weekday_volume": _on(charts.weekday_volume, "day_of_week"),
    # model inputs and metrics
    "imputed_features": _on(
        lambda v: learning.impute(v, learning.NUMBERS), "patient_id", *learning.NUMBERS
    ),
    "label_codes": _on(learning.label_codes, *learning.CATEGORIES),
    "feature_matrix": _on(lambda v: learning.feature_matrix(v, "patient_id")[0], *_FEATURES),
    "stratified_split": _on(
        lambda v: sampling.with_test_flag(v, label="is_admitted"), "patient_id", "is_admitted"
    ),
    "plain_split": _on(sampling.with_test_flag, "patient_id"),
    "stratified_folds": _on(lambda v: sampling.with_fold(v, "is_admitted"), "patient_id", "is_admitted"),
    "sampled_visits": _on(lambda v: sampling.sample_exact(v, 2000), "patient_id", "wait_time"),
    "segment_features": _on(
        _rounded(lambda v: learning.segment_features(v, "patient_id"), 4, *learning.SEGMENT_FEATURES), *_SEGMENT
    ),
    "accuracy": _on(lambda v: learning.accuracy(_predicted(v)), "is_admitted", "wait_time"),
    "classification_report": _on(
        _rounded(lambda v: learning.classification_report(_predicted(v)), 6, "precision", "recall", "f1"),
        "is_admitted", "wait_time",
    ),
    "class_table": _on(
        lambda v: learning.class_table(learning.classification_report(_predicted(v))), "is_admitted", "wait_time"
    ),
    "confusion_matrix": _on(lambda v: learning.confusion(_predicted(v)), "is_admitted", "wait_time"),
    "regression_metrics": _on(
        _rounded(lambda v: learning.regression_metrics(_predicted_scores(v)), 4, "mae", "r2"),
        "satisfaction_score", "wait_time",
    ),
    "cluster_profiles": _on(
        _cluster_profiles, "age", "wait_time", "satisfaction_score_filled", "is_admitted", "has_referral"
    ),
    # models (iterative, so without a SQL twin)
    "admission_model_metrics": _admission(lambda t: t.metrics),
    "admission_model_report": _admission(lambda t: learning.classification_report(t.predictions), folds=0),
    "admission_importances": _admission(lambda t: t.importances, folds=0),
    "score_model_metrics": _score(lambda t: t.metrics),
    "score_importances": _score(lambda t: t.importances),
    "patient_segments": _on(
        lambda v: learning.cluster_table(learning.segment_from_fixed_starts(v).profiles), *_SEGMENT),
    "segment_scatter": _on(
        lambda v: charts.segment_scatter(learning.segment_from_fixed_starts(v).clustered), *_SEGMENT),
    "patient_segments_drawn": _on(
        lambda v: learning.cluster_table(learning.segment(v, parallelism=5).profiles), *_SEGMENT),
    "segment_scatter_drawn": _on(
        lambda v: charts.segment_scatter(learning.segment(v, parallelism=5).clustered), *_SEGMENT),
    # quality
    "quality_summary": _on(quality.summary),
    "quarantined_visits": _on(_quarantined),
    "duplicate_ids": _on(
        lambda v: quality.duplicate_ids(v.select(F.col("patient_name").alias("patient_id"))), "patient_name"
    ),
    "duplicate_order_ids": _order_ids,
    "departments_filled": _departments_filled,
    "short_time_labels": _on(
        lambda v: relabel_time_of_day(v, _SHORT).groupBy("time_of_day").agg(F.count(F.lit(1)).alias("visits")), "hour"
    ),
    "quick_chart_of_departments": _on(_quick_chart, "department_referral"),
    "assigned_segments": _on(lambda v: _assigned(v).select("patient_id", "cluster"), *_POINT),
    "assigned_inertia": _on(_rounded(lambda v: learning.inertia(_assigned(v)), 2, "inertia"), *_POINT),
    "table_shape": _on(quality.shape),
}


def _optional(module: str) -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of a part of the library that may be absent."""
    try:
        part = import_module(module)
    except ModuleNotFoundError as error:
        if error.name not in ("visitflow.llm", module):
            raise
        return {}, {}
    return part.QUERIES, part.ORACLE


for _part in ("visitflow.llm.registry", "corpus_pipeline"):
    _queries, _oracle = _optional(_part)
    _Q.update(_queries)
    ORACLE = {**ORACLE, **_oracle}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: department performance on the smallest data set."""
    return _Q["department_performance"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """Every registered query by name."""
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same result, for every query that SQL can express."""
    return dict(ORACLE)
