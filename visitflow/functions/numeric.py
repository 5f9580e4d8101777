"""Rounding, rates and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 2) -> Column:
    """Round by scaling, ties to the even neighbour (the data-frame convention)."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def half_up(value: Column, digits: int = 2) -> Column:
    """Round, ties away from zero (the SQL convention)."""
    return F.round(value, digits)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as a double, null when the whole is zero."""
    return F.try_divide(part.cast("double") * 100.0, whole)


def share(flag: Column) -> Column:
    """Aggregate: fraction of rows where the flag holds (null rows count as neither)."""
    return F.avg(flag.cast("int"))


def rate_pct(flag: Column) -> Column:
    """Aggregate: percentage of all rows where the flag holds, SQL rounding to two digits."""
    return half_up(percent(F.count_if(flag), F.count(F.lit(1))))


def mean_2(value: Column) -> Column:
    """Aggregate: mean, SQL rounding to two digits."""
    return half_up(F.avg(value))


def as_text(value: Column, digits: int, suffix: str = "", missing: str = "nan") -> Column:
    """Fixed-point text with a suffix; ``missing`` where there is no value."""
    text = F.format_string(f"%.{digits}f{suffix.replace('%', '%%')}", F.bround(value, digits))
    return F.when(value.isNotNull(), text).otherwise(F.lit(missing))
