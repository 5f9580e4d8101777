"""From raw text rows to the full visit table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.functions import scalars
from visitflow.operators.quantiles import median
from visitflow.sources import schema as S


def parse(raw: DataFrame, referral_null_mode: str = "literal") -> DataFrame:
    """Type the text columns that are present; anything that does not parse becomes null.

    A visit without referral holds the word ``None``. ``referral_null_mode="literal"`` keeps that word and writes it
    for an empty field too; ``"null"`` reads the word as a missing value, so that such rows drop out of department
    groups and ``has_referral`` holds everywhere.
    """
    department = F.col("department_referral")
    if referral_null_mode == "literal":
        department = F.coalesce(department, F.lit("None"))
    elif referral_null_mode == "null":
        department = F.nullif(department, F.lit("None"))
    else:
        raise ValueError(f"referral_null_mode must be 'literal' or 'null', not {referral_null_mode!r}")
    parsed = {
        "admission_date": scalars.visit_date(F.col("admission_date")),
        "admission_time": scalars.visit_time(F.col("admission_time")),
        "department_referral": department,
    }
    return raw.withColumns({name: column for name, column in parsed.items() if name in raw.columns})


def _derivations(referral_null_mode: str) -> dict[str, Callable[[], Column]]:
    def referral() -> Column:
        flag = scalars.has_referral(F.col("department_referral"))
        return F.coalesce(flag, F.lit(True)) if referral_null_mode == "null" else flag

    date, hour = partial(F.col, "admission_date"), lambda: scalars.hour_of(F.col("admission_time"))
    return {
        "year": lambda: F.year(date()),
        "month": lambda: F.month(date()),
        "month_name": lambda: F.date_format(date(), "MMMM"),
        "day_of_week": lambda: F.date_format(date(), "EEEE"),
        "week_number": lambda: scalars.iso_week(date()),
        "hour": hour,
        "time_of_day": lambda: scalars.time_of_day(hour()),
        "age_group": lambda: scalars.age_group(F.col("age")),
        "wait_category": lambda: scalars.wait_category(F.col("wait_time")),
        "is_admitted": lambda: scalars.is_admitted(F.col("admission_flag")),
        "has_referral": referral,
    }


def derive(base: DataFrame, referral_null_mode: str = "literal", only: Sequence[str] | None = None) -> DataFrame:
    """Add the derived columns (or ``only`` some) whose source column is present."""
    present = set(base.columns)
    added = {
        name: build()
        for name, build in _derivations(referral_null_mode).items()
        if S.DERIVED_FROM[name] in present and (only is None or name in only)
    }
    return base.withColumns(added) if added else base


def fill_scores(visits: DataFrame) -> DataFrame:
    """Add ``satisfaction_score_filled``: the score, or the median of all scores in ``visits``."""
    score = F.col("satisfaction_score")
    return visits.withColumn("satisfaction_score_filled", F.coalesce(score, median(visits, "satisfaction_score")))


def relabel_time_of_day(visits: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The same time-of-day buckets under other labels."""
    return visits.withColumn("time_of_day", scalars.time_of_day(F.col("hour"), labels))


def sql_view(visits: DataFrame) -> DataFrame:
    """The table as SQL text sees it: flags are 0/1 integers, so that ``is_admitted = 1`` holds."""
    flags = [f for f in ("is_admitted", "has_referral") if f in visits.columns]
    return visits.withColumns({f: scalars.as_int(F.col(f)) for f in flags})
