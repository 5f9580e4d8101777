"""Row filters over the visit table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.sources import schema as S


def _one_of(column: Column, values: Sequence) -> Column:
    return column.isin(*values) if values else F.lit(False)


def _date_span(years: Sequence[int], column: str, kind: str) -> Column:
    """Implied by ``year IN years``; unlike the year itself it is a plain comparison the Parquet scan can use."""
    first, after = f"{min(years):04d}-01-01", f"{max(years) + 1:04d}-01-01"
    return (F.col(column) >= F.lit(first).cast(kind)) & (F.col(column) < F.lit(after).cast(kind))


def admission(visits: DataFrame, status: str = "All") -> DataFrame:
    """Keep all visits, those admitted, or those not admitted."""
    flag = F.col("admission_flag").eqNullSafe(F.lit(S.ADMITTED))
    keep = {"All": F.lit(True), "Admitted Only": flag, "Not Admitted Only": ~flag}
    if status not in keep:
        raise ValueError(f"unknown admission status {status!r}")
    return visits.where(keep[status])


def select_visits(
    visits: DataFrame,
    years: Sequence[int] | None = None,
    genders: Sequence[str] | None = None,
    departments: Sequence[str] | None = None,
    status: str = "All",
    stored_date: str = "admission_date",
) -> DataFrame:
    """Visits whose year, gender and department are among the selected values; a missing value never matches.

    ``None`` stands for every value there is, an empty list for no value at all. ``stored_date`` names a stored date or
    time column that is the visit's date wherever the visit has one: the years imply a range of it, which the scan can
    use even where ``admission_date`` itself is derived.
    """
    if years:
        visits = visits.where(_date_span(years, stored_date, visits.schema[stored_date].dataType.simpleString()))
    for name, values in (("year", years), ("gender", genders), ("department_referral", departments)):
        column = F.col(name)
        visits = visits.where(column.isNotNull() if values is None else _one_of(column, values))
    return admission(visits, status)


def choices(visits: DataFrame) -> DataFrame:
    """The values each filter offers, sorted: rows of ``(filter, value)``."""
    names = ["year", "gender", "department_referral"]
    combinations = visits.select(*[F.col(c).cast("string").alias(c) for c in names]).distinct()
    values = combinations.unpivot([], names, "filter", "value").where(F.col("value").isNotNull()).distinct()
    return values.orderBy("filter", "value")


def is_empty(visits: DataFrame) -> bool:
    """Whether a selection holds no visit; reads no more than it needs to find one."""
    return visits.isEmpty()


def long_wait_admitted(visits: DataFrame, minutes: int = 50) -> DataFrame:
    return visits.where((F.col("wait_time") > minutes) & (F.col("admission_flag") == S.ADMITTED))


def low_scores(visits: DataFrame, at_most: float = 3) -> DataFrame:
    return visits.where(F.col("satisfaction_score").isNotNull() & (F.col("satisfaction_score") <= at_most))


def scored(visits: DataFrame) -> DataFrame:
    return visits.where(F.col("satisfaction_score").isNotNull())


def with_hour(visits: DataFrame) -> DataFrame:
    return visits.where(F.col("hour").isNotNull())


def complete(visits: DataFrame, *columns: str) -> DataFrame:
    """Drop visits that miss any of the columns."""
    return visits.dropna(subset=list(columns))


def search(visits: DataFrame, text: str, literal: bool = False) -> DataFrame:
    """Visits whose id or name matches, ignoring case: a regular expression, or plain text with ``literal=True``."""
    if not text:
        return visits

    def hit(column: Column) -> Column:
        found = F.contains(F.lower(column), F.lit(text.lower())) if literal else column.rlike(f"(?i){text}")
        return F.coalesce(found, F.lit(False))

    return visits.where(hit(F.col("patient_id")) | hit(F.col("patient_name")))


def browse(visits: DataFrame, text: str = "") -> DataFrame:
    """The record browser: matching visits, display columns only."""
    return search(visits, text).select(*S.BROWSE_COLUMNS)
