"""Measures kept per day, from which the headline numbers of any range of days follow without reading visits.

Sums and counts add up; distinct ids do not, so a day keeps a HyperLogLog sketch of them, and sketches merge. A sketch of
``2 ** BITS`` cells has a fixed size and a standard error of about ``1.04 / sqrt(2 ** BITS)`` of the count: 0.8 % at 14
bits. Few different values (departments) are counted exactly by the sketch's list form.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.functions.numeric import percent

BITS = 14
_DATE_TEXT = "MMM dd, yyyy"


def daily_measures(visits: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each admission date (null: unknown), with ``year`` and ``month`` to store it by.

    Combined before the shuffle: a task sends one row, with its sketches, for each day it has seen.
    """
    wait, score, gender = F.col("wait_time"), F.col("satisfaction_score"), F.col("gender")
    return visits.groupBy("admission_date").agg(
        F.count(F.lit(1)).alias("visits"),
        F.count_if("is_admitted").alias("admitted"),
        F.count("is_admitted").alias("admission_known"),
        F.sum(wait.cast("double")).alias("wait_sum"), F.count(wait).alias("wait_known"),
        F.sum(score.cast("double")).alias("score_sum"), F.count(score).alias("score_known"),
        F.count_if(gender == "Male").alias("male"), F.count_if(gender == "Female").alias("female"),
        F.hll_sketch_agg("patient_id", bits).alias("patients"),
        F.hll_sketch_agg("department_referral", bits).alias("departments"),
    ).withColumns({"year": F.year("admission_date"), "month": F.month("admission_date")})


def write_daily(visits: DataFrame, path: str, bits: int = BITS) -> None:
    """Store the days, a folder for each month."""
    days = daily_measures(visits, bits)
    days.hint("rebalance", "year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(path)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _within(first: date | None, last: date | None) -> Column:
    """The days of a range, both ends included; months outside it are not opened."""
    month, found = F.col("year") * 12 + F.col("month"), F.lit(True)
    if first:
        found &= (month >= first.year * 12 + first.month) & (F.col("admission_date") >= F.lit(first))
    if last:
        found &= (month <= last.year * 12 + last.month) & (F.col("admission_date") <= F.lit(last))
    return found


def kpis_of_days(days: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
    """One row of headline numbers of a range of days; without a range, of all days and the visits without a date.

    ``unique_patients`` and ``unique_departments`` are estimates with the error of the sketches.
    """
    found = days.where(_within(first, last)).agg(
        F.coalesce(F.sum("visits"), F.lit(0)).alias("total_patients"),
        F.sum("admitted").alias("a"), F.sum("admission_known").alias("an"),
        F.sum("wait_sum").alias("w"), F.sum("wait_known").alias("wn"),
        F.sum("score_sum").alias("s"), F.sum("score_known").alias("sn"),
        F.sum("male").alias("m"), F.sum("female").alias("f"),
        F.min("admission_date").alias("low"), F.max("admission_date").alias("high"),
        F.hll_union_agg("patients").alias("p"), F.hll_union_agg("departments").alias("d"),
    )
    n = F.col("total_patients")
    return found.select(
        n,
        percent(F.col("a"), F.col("an")).alias("admission_rate"),
        F.try_divide("w", "wn").alias("avg_wait_time"),
        F.try_divide("s", "sn").alias("avg_satisfaction"),
        F.hll_sketch_estimate("d").alias("unique_departments"),
        F.hll_sketch_estimate("p").alias("unique_patients"),
        F.date_format("low", _DATE_TEXT).alias("date_range_start"),
        F.date_format("high", _DATE_TEXT).alias("date_range_end"),
        percent(F.col("sn"), n).alias("pct_with_score"),
        percent(F.col("m"), n).alias("pct_male"),
        percent(F.col("f"), n).alias("pct_female"),
    )
