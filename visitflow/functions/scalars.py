"""Derivations of the visit table, one column function each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitflow.sources import schema as S


def visit_date(text: Column) -> Column:
    """Date of ``month/day/year`` text; text that is no such date gives null."""
    return F.try_to_date(text, S.DATE_PATTERN)


def _clock(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(S.TIME_PATTERN))


def visit_time(text: Column) -> Column:
    """12-hour clock text as ``HH:mm:ss``; text that is no such time gives null."""
    return F.date_format(_clock(text), "HH:mm:ss")


def hour_of(time: Column) -> Column:
    """Hour of an ``HH:mm:ss`` time."""
    return F.substring(time, 1, 2).cast("int")


def iso_week(date: Column) -> Column:
    """ISO week number, 0 for a missing date."""
    return F.coalesce(F.weekofyear(date), F.lit(0))


def time_of_day(hour: Column, labels: Mapping[str, str] = S.TIME_OF_DAY) -> Column:
    return (
        F.when(hour.isNull(), labels["unknown"])
        .when((hour >= 6) & (hour < 12), labels["morning"])
        .when((hour >= 12) & (hour < 18), labels["afternoon"])
        .when((hour >= 18) & (hour < 24), labels["evening"])
        .otherwise(labels["night"])
    )


def cut(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(low, high]`` that holds the value; null outside all bins."""
    bins = list(zip(edges, edges[1:], labels, strict=False))
    low, high, label = bins[0]
    out = F.when((value > low) & (value <= high), label)
    for low, high, label in bins[1:]:
        out = out.when((value > low) & (value <= high), label)
    return out


def age_group(age: Column) -> Column:
    return cut(age, S.AGE_BINS, S.AGE_GROUPS)


def wait_category(wait: Column) -> Column:
    return cut(wait, S.WAIT_BINS, S.WAIT_CATEGORIES)


def wait_bucket(wait: Column) -> Column:
    """Bucket of the satisfaction-by-wait query: zero counts as short, a missing wait as longest."""
    short, middle, long, rest = S.WAIT_BUCKETS
    return F.when(wait <= 20, short).when(wait <= 40, middle).when(wait <= 60, long).otherwise(rest)


def is_admitted(flag: Column) -> Column:
    """True for an admission; a missing flag is not an admission."""
    return flag.eqNullSafe(F.lit(S.ADMITTED))


def has_referral(department: Column) -> Column:
    return department != S.NO_REFERRAL


def in_order(label: Column, labels: Sequence[str]) -> Column:
    """Position of a label in its category, for ordering; 0 when it is not one of them."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in labels]), label), F.lit(0))


def as_int(flag: Column) -> Column:
    return flag.cast("int")
