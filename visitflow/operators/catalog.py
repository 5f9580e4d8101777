"""The named SQL-style reports. Groups keep a missing key as a group of its own; rounding is half away from zero."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.functions.numeric import half_up, mean_2, rate_pct
from visitflow.functions.scalars import in_order, wait_bucket
from visitflow.operators import filters
from visitflow.sources import schema as S

Report = Callable[[DataFrame], DataFrame]


def _count(name: str = "patient_count") -> Column:
    return F.count(F.lit(1)).alias(name)


def _rate() -> Column:
    return rate_pct(F.col("admission_flag") == S.ADMITTED).alias("admission_rate_pct")


def _wait(name: str = "avg_wait_min") -> Column:
    return mean_2(F.col("wait_time")).alias(name)


def _score(name: str = "avg_satisfaction") -> Column:
    return mean_2(F.col("satisfaction_score")).alias(name)


def volume_summary(visits: DataFrame) -> DataFrame:
    return visits.agg(_count("total_patients"), _rate(), _wait(), _score("avg_satisfaction_score"))


def department_performance(visits: DataFrame) -> DataFrame:
    return (
        visits.groupBy(F.col("department_referral").alias("department"))
        .agg(_count(), _rate(), _wait(), _score())
        .orderBy(F.desc("patient_count"), F.asc_nulls_last("department"))
    )


def equity_by_race(visits: DataFrame) -> DataFrame:
    admitted = F.count_if(F.col("admission_flag") == S.ADMITTED).alias("admitted")
    return (
        visits.groupBy("race")
        .agg(_count("total"), admitted, _rate(), _wait(), _score())
        .orderBy(F.desc("admission_rate_pct"), F.asc_nulls_last("race"))
    )


def by_gender(visits: DataFrame) -> DataFrame:
    return visits.groupBy("gender").agg(_count(), _rate(), _wait(), _score())


def by_age_group(visits: DataFrame) -> DataFrame:
    youngest = F.min("age").alias("youngest")
    return (
        visits.groupBy("age_group")
        .agg(_count(), half_up(F.avg("age"), 1).alias("avg_age"), _rate(), _wait(), youngest)
        .orderBy(F.asc_nulls_first("youngest"))
        .drop("youngest")
    )


def hourly(visits: DataFrame, known_hours_only: bool = True) -> DataFrame:
    rows = filters.with_hour(visits) if known_hours_only else visits
    return rows.groupBy("hour").agg(_count(), _rate(), _wait()).orderBy(F.asc_nulls_first("hour"))


def by_weekday(visits: DataFrame) -> DataFrame:
    # Anything that is not Monday to Saturday sorts with Sunday.
    place = F.when(F.col("day_of_week").isin(*S.WEEKDAYS[:-1]), in_order(F.col("day_of_week"), S.WEEKDAYS))
    return (
        visits.groupBy("day_of_week")
        .agg(_count(), _wait(), _score())
        .orderBy(F.coalesce(place, F.lit(len(S.WEEKDAYS))), F.asc_nulls_last("day_of_week"))
    )


def monthly_trend(visits: DataFrame) -> DataFrame:
    return (
        visits.groupBy("year", "month", "month_name")
        .agg(_count(), _wait())
        .orderBy(F.asc_nulls_first("year"), F.asc_nulls_first("month"))
    )


def long_wait_alerts(visits: DataFrame, n: int = 50) -> DataFrame:
    """Admitted visits that waited longest, ties by id."""
    return (
        filters.long_wait_admitted(visits)
        .orderBy(F.desc("wait_time"), "patient_id")
        .limit(n)
        .select(
            "patient_id", "age", "gender", "race", "department_referral", "wait_time", "satisfaction_score",
            "admission_date",
        )
    )


def _low_score_groups(visits: DataFrame, keys: tuple[str, ...], n: int, *measures: Column) -> DataFrame:
    return (
        filters.low_scores(visits)
        .groupBy(*keys)
        .agg(_count("count"), _score("avg_score"), *measures)
        .orderBy(F.desc("count"), *[F.asc_nulls_last(k) for k in keys])
        .limit(n)
    )


def low_score_groups(visits: DataFrame, n: int = 20) -> DataFrame:
    return _low_score_groups(
        visits, ("race", "gender", "age_group", "department_referral"), n, _wait("avg_wait")
    )


def score_by_wait_bucket(visits: DataFrame) -> DataFrame:
    return (
        filters.scored(visits)
        .groupBy(wait_bucket(F.col("wait_time")).alias("wait_bucket"))
        .agg(_count(), _score(), F.min("wait_time").alias("shortest"))
        .orderBy(F.asc_nulls_first("shortest"))
        .drop("shortest")
    )


def yearly(visits: DataFrame) -> DataFrame:
    return (
        visits.groupBy("year")
        .agg(_count("total_patients"), _rate(), _wait(), _score())
        .orderBy(F.asc_nulls_first("year"))
    )


def dept_summary(visits: DataFrame) -> DataFrame:
    return visits.groupBy(F.col("department_referral").alias("department")).agg(
        _count("total_patients"), _rate(), _wait(), _score()
    )


def daily_volume(visits: DataFrame) -> DataFrame:
    return (
        visits.groupBy("admission_date").agg(_count(), _wait()).orderBy(F.asc_nulls_first("admission_date"))
    )


LIBRARY: dict[str, Report] = {
    "volume_summary": volume_summary,
    "department_performance": department_performance,
    "equity_by_race": lambda v: equity_by_race(v).drop("admitted"),
    "by_gender": by_gender,
    "by_age_group": by_age_group,
    "hourly": hourly,
    "by_weekday": by_weekday,
    "monthly_trend": monthly_trend,
    "long_wait_alerts": long_wait_alerts,
    "low_score_groups": low_score_groups,
    "score_by_wait_bucket": score_by_wait_bucket,
    "yearly": yearly,
}

_RACE_COLUMNS = ("race", "total", "admitted", "admission_rate_pct")
_HOUR_COLUMNS = ("hour", "patient_count", "avg_wait_min")

# --- fixed values: the names of presets and report queries ---------------------------------------------------------
# The ready-made queries of the SQL explorer, under the names it shows.
PRESETS: dict[str, Report] = {
    "Patient Volume Summary": lambda v: volume_summary(v).withColumnRenamed(
        "avg_satisfaction_score", "avg_satisfaction"
    ),
    "Department Performance": lambda v: department_performance(v).select(
        "department", "patient_count", "avg_wait_min", "avg_satisfaction", "admission_rate_pct"
    ),
    "Admission Rate by Race": lambda v: equity_by_race(v).select(*_RACE_COLUMNS),
    "Hourly Peak Analysis": lambda v: hourly(v).select(*_HOUR_COLUMNS),
    "Monthly Volume Trend": lambda v: monthly_trend(v).withColumnRenamed("avg_wait_min", "avg_wait"),
    "High Wait + Admitted": lambda v: long_wait_alerts(v, 20).drop("admission_date"),
}

# The queries of the statistical report, under its names.
REPORT: dict[str, Report] = {
    "top_departments_by_volume": lambda v: department_performance(v).drop("admission_rate_pct"),
    "admission_rate_by_race": lambda v: equity_by_race(v).select(*_RACE_COLUMNS),
    "hourly_peak_analysis": lambda v: hourly(v).select(*_HOUR_COLUMNS),
    "high_wait_admitted_patients": lambda v: long_wait_alerts(v, 20).drop("admission_date"),
    "monthly_volume_trend": lambda v: monthly_trend(v).withColumnRenamed("avg_wait_min", "avg_wait"),
    "satisfaction_low_scorers": lambda v: _low_score_groups(v, ("race", "gender", "age_group"), 15),
}
# --- end of fixed values -------------------------------------------------------------------------------------------


def register_views(visits: DataFrame) -> None:
    """The two summary views, next to the ``patients`` table."""
    dept_summary(visits).createOrReplaceTempView("dept_summary")
    daily_volume(visits).createOrReplaceTempView("daily_volume")
