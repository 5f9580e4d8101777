"""Headline numbers and grouped measures of the data-frame analyses.

Groups here leave out rows whose key is missing (the SQL catalog keeps them). Where one analysis needs the same
measures along several dimensions, the table is aggregated once by all of them; the dimensions are low-cardinality
categories, so what remains is a small cube, and the single dimensions are summed up from that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.functions.numeric import as_text, half_even, percent, share
from visitflow.sources import schema as S

# --- fixed values: the dimensions of each analysis ----------------------------------------------------------------
ADMISSION_DIMENSIONS = ("gender", "race", "age_group", "department_referral")
WAIT_DIMENSIONS = ("day_of_week", "time_of_day", "department_referral")
SCORE_DIMENSIONS = ("gender", "race", "age_group", "admission_flag")
FREQUENCY_DIMENSIONS = ("gender", "race", "department_referral", "time_of_day")
TIME_DIMENSIONS = ("year", "month_name", "day_of_week", "hour")

_DATE_TEXT = "MMM dd, yyyy"
# --- end of fixed values ------------------------------------------------------------------------------------------


def kpi_row(visits: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    date, score = F.col("admission_date"), F.col("satisfaction_score")
    return visits.agg(
        F.count(F.lit(1)).alias("total_patients"),
        (share(F.col("is_admitted")) * 100).alias("admission_rate"),
        F.avg("wait_time").alias("avg_wait_time"),
        F.avg(score).alias("avg_satisfaction"),
        F.countDistinct("department_referral").alias("unique_departments"),
        F.date_format(F.min(date), _DATE_TEXT).alias("date_range_start"),
        F.date_format(F.max(date), _DATE_TEXT).alias("date_range_end"),
        (share(score.isNotNull()) * 100).alias("pct_with_score"),
        (share(F.col("gender").eqNullSafe(F.lit("Male"))) * 100).alias("pct_male"),
        (share(F.col("gender").eqNullSafe(F.lit("Female"))) * 100).alias("pct_female"),
    )


def by_dimension(
    visits: DataFrame, dimensions: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Long frame ``(dimension, key, *sums)``: additive measures along each dimension, null keys left out."""
    cube = visits.groupBy(*dimensions).agg(*[column.alias(name) for name, column in sums.items()])
    keys = [F.col(d).cast("string").alias(d) for d in dimensions]
    long = cube.select(*keys, *sums).unpivot(list(sums), list(dimensions), "dimension", "key")
    return (
        long.where(F.col("key").isNotNull())
        .groupBy("dimension", "key")
        .agg(*[F.sum(name).alias(name) for name in sums])
    )


def _sum_and_count(column: Column) -> dict[str, Column]:
    return {"total": F.sum(column.cast("double")), "n": F.count(column)}


def admission_rates(visits: DataFrame, dimensions: Sequence[str] = ADMISSION_DIMENSIONS) -> DataFrame:
    """Admission percentage along each dimension."""
    long = by_dimension(visits, dimensions, _sum_and_count(F.col("is_admitted").cast("int")))
    return long.select(
        "dimension", "key", half_even(F.try_divide(F.col("total"), F.col("n")) * 100).alias("admission_rate")
    ).orderBy("dimension", "key")


def overall_admission_rate(visits: DataFrame) -> DataFrame:
    return visits.agg((share(F.col("is_admitted")) * 100).alias("overall_rate"))


def _means(visits: DataFrame, measure: str, dimensions: Sequence[str], name: str) -> DataFrame:
    long = by_dimension(visits, dimensions, _sum_and_count(F.col(measure)))
    mean = half_even(F.try_divide(F.col("total"), F.col("n")))
    return long.select("dimension", "key", mean.alias(name)).orderBy("dimension", "key")


def mean_waits(visits: DataFrame, dimensions: Sequence[str] = WAIT_DIMENSIONS) -> DataFrame:
    return _means(visits, "wait_time", dimensions, "avg_wait")


def mean_scores(visits: DataFrame, dimensions: Sequence[str] = SCORE_DIMENSIONS) -> DataFrame:
    """Mean score along each dimension, over scored visits only."""
    return _means(
        visits.where(F.col("satisfaction_score").isNotNull()), "satisfaction_score", dimensions, "avg_score"
    )


def score_summary(visits: DataFrame) -> DataFrame:
    score = F.col("satisfaction_score")
    return visits.agg(
        F.count(score).alias("n_scored"),
        percent(F.count(score), F.count(F.lit(1))).alias("pct_scored"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
    )


def frequencies(visits: DataFrame, dimensions: Sequence[str] = FREQUENCY_DIMENSIONS) -> DataFrame:
    """Number of visits per value of each dimension, most frequent first."""
    long = by_dimension(visits, dimensions, {"n": F.count(F.lit(1))})
    return long.orderBy("dimension", F.desc("n"), "key")


def age_group_frequencies(visits: DataFrame) -> DataFrame:
    """Visits per age group in category order; a group without visits counts zero."""
    groups = S.category_frame(visits.sparkSession, S.AGE_GROUPS, "age_group")
    counts = visits.where(F.col("age_group").isin(*S.AGE_GROUPS)).groupBy("age_group").agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most one row per age group, hence the broadcast.
    return (
        groups.join(F.broadcast(counts), "age_group", "left")
        .orderBy("rank")
        .select("age_group", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))
    )


def temporal_counts(visits: DataFrame, dimensions: Sequence[str] = TIME_DIMENSIONS) -> DataFrame:
    """Number of visits per year, month name (years merged), weekday and hour."""
    return by_dimension(visits, dimensions, {"n": F.count(F.lit(1))}).orderBy("dimension", "key")


def mean_wait_by_hour(visits: DataFrame) -> DataFrame:
    return (
        visits.where(F.col("hour").isNotNull())
        .groupBy("hour")
        .agg(half_even(F.avg("wait_time")).alias("avg_wait"))
        .orderBy("hour")
    )


def yearly_table(visits: DataFrame) -> DataFrame:
    """Year-over-year numbers as display text."""
    numbers = (
        visits.where(F.col("year").isNotNull())
        .groupBy("year")
        .agg(
            F.count("patient_id").alias("patients"),
            (share(F.col("is_admitted")) * 100).alias("rate"),
            F.avg("wait_time").alias("wait"),
            F.avg("satisfaction_score").alias("score"),
        )
    )
    return numbers.select(
        "year",
        "patients",
        as_text(F.col("rate"), 1, "%").alias("admission_rate"),
        as_text(F.col("wait"), 1, " min", missing="nan min").alias("avg_wait"),
        as_text(F.col("score"), 2, missing="N/A").alias("avg_satisfaction"),
    ).orderBy("year")


def department_table(visits: DataFrame) -> DataFrame:
    """Department summary; the rate is rounded to two digits as a fraction before it becomes a percentage."""
    measured = (
        visits.where(F.col("department_referral").isNotNull())
        .groupBy(F.col("department_referral").alias("department"))
        .agg(
            F.count("patient_id").alias("patients"),
            half_even(F.avg("wait_time")).alias("avg_wait"),
            half_even(share(F.col("is_admitted"))).alias("fraction"),
            half_even(F.avg("satisfaction_score")).alias("avg_score"),
        )
    )
    rate = half_even(F.col("fraction") * 100, 1)
    return measured.select(
        "department", "patients", "avg_wait", as_text(rate, 1, "%").alias("admission_rate"), "avg_score"
    ).orderBy(F.desc("patients"), "department")
