"""Descriptive and inferential statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.functions.numeric import half_even, percent
from visitflow.functions.student import p_value, significance
from visitflow.operators import filters
from visitflow.operators.membership import mark_members, members_only
from visitflow.operators.quantiles import sketched, value_counts

# --- fixed values -------------------------------------------------------------------------------------------------
FENCE = 1.5  # interquartile ranges beyond the quartiles
_ANOMALY_COLUMNS = (
    "patient_id", "gender", "age", "race", "department_referral", "wait_time", "admission_flag",
)
# --- end of fixed values ------------------------------------------------------------------------------------------


def _spread(counts: DataFrame, column: str) -> DataFrame:
    """One row ``n, mean, std, low, high, q`` (quartiles) of weighted values."""
    value, n = F.col(column).cast("double"), F.col("n")
    mean = F.try_divide(F.sum(value * n), F.sum(n))
    center = counts.agg(mean.alias("mean")).scalar()
    off = value - center
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"),
        mean.alias("mean"),
        F.sqrt(F.try_divide(F.sum(n * off * off), F.sum(n) - 1)).alias("std"),
        F.min(column).alias("low"),
        F.max(column).alias("high"),
        quartiles.alias("q"),
    )


def _summary(visits: DataFrame, column: str, accuracy: float | None) -> DataFrame:
    """:func:`_spread` of a column: exact, or with quartiles from a sketch and the rest from one more aggregate."""
    if not accuracy:
        return _spread(value_counts(visits, column), column)
    quartiles = sketched(visits, column, [0.25, 0.5, 0.75], accuracy).select("q").scalar()
    value = F.col(column).cast("double")
    return visits.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(column).alias("low"), F.max(column).alias("high"),
    ).withColumn("q", quartiles)


def wait_summary(visits: DataFrame, accuracy: float | None = None) -> DataFrame:
    """Mean, median, sample deviation, range and quartiles of the wait.

    ``accuracy``: the largest error of the quartiles in rank, for waits of so many different values (fractions of minutes)
    that counting each is no gain; without it they are exact and interpolated.
    """
    row = _summary(visits, "wait_time", accuracy)
    q = F.col("q")
    return row.select(
        "mean", q[1].alias("median"), "std", F.col("low").alias("min"), F.col("high").alias("max"),
        q[0].alias("p25"), q[2].alias("p75"),
    )


def describe(visits: DataFrame, column: str = "age", accuracy: float | None = None) -> DataFrame:
    """Count, mean, deviation, range and quartiles of a column, two digits: rows of ``(statistic, value)``.

    ``accuracy``: as in :func:`wait_summary`.
    """
    row = _summary(visits, column, accuracy)
    q = F.col("q")
    parts = {
        "count": F.col("n"), "mean": F.col("mean"), "std": F.col("std"), "min": F.col("low"), "25%": q[0],
        "50%": q[1], "75%": q[2], "max": F.col("high"),
    }
    wide = row.select(*[half_even(c.cast("double")).alias(name) for name, c in parts.items()])
    return wide.unpivot([], list(parts), "statistic", "value")


def wait_t_test(visits: DataFrame) -> DataFrame:
    """Student's two-sample test of the wait, admitted against not admitted, equal variances.

    Null statistic and p-value when a side has no wait or nothing varies.
    """
    flag, wait = F.col("is_admitted"), F.col("wait_time")

    def side(which: Column, tag: str) -> list[Column]:
        values = F.when(which, wait)
        return [
            F.count(values).alias(f"n{tag}"),
            F.avg(values).alias(f"mean{tag}"),
            F.coalesce(F.var_samp(values), F.lit(0.0)).alias(f"var{tag}"),
        ]

    n1, n0 = F.col("n1"), F.col("n0")
    df = n1 + n0 - 2
    pooled = F.try_divide((n1 - 1) * F.col("var1") + (n0 - 1) * F.col("var0"), df)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)))
    t = F.try_divide(F.col("mean1") - F.col("mean0"), error)
    return (
        visits.agg(*side(flag, "1"), *side(~flag, "0"))
        .select(t.alias("t"), df.alias("df"))
        .withColumn("p", p_value(F.col("t"), F.col("df")))
        .select(
            half_even(F.col("t"), 4).alias("t_stat"),
            "df",
            half_even(F.col("p"), 4).alias("p_value"),
            significance(half_even(F.col("p"), 4)).alias("verdict"),
        )
    )


def score_wait_correlation(visits: DataFrame) -> DataFrame:
    """Pearson correlation of score and wait over visits that have both, with its two-sided p-value."""
    r, n = F.col("r"), F.col("n")
    df = n - 2
    t = r * F.sqrt(F.try_divide(df, 1 - r * r))
    p = (
        F.when(n == 2, F.lit(1.0))
        .when(F.abs(r) >= 1, F.lit(0.0))
        .otherwise(p_value(F.col("t"), df))
    )
    return (
        filters.complete(visits, "satisfaction_score", "wait_time")
        .agg(F.corr("satisfaction_score", "wait_time").alias("r"), F.count(F.lit(1)).alias("n"))
        .withColumn("t", t)
        .withColumn("p", p)
        .select(
            "n",
            half_even(r, 4).alias("pearson_r"),
            half_even(F.col("p"), 4).alias("p_value"),
            significance(half_even(F.col("p"), 4)).alias("verdict"),
        )
    )


def trend(visits: DataFrame) -> DataFrame:
    """Least-squares line of score on wait, and the range of waits it covers: one row."""
    pairs = filters.complete(visits, "satisfaction_score", "wait_time")
    return pairs.agg(
        F.regr_slope("satisfaction_score", "wait_time").alias("slope"),
        F.regr_intercept("satisfaction_score", "wait_time").alias("intercept"),
        F.min("wait_time").alias("low"),
        F.max("wait_time").alias("high"),
    )


def trend_line(visits: DataFrame, points: int = 100) -> DataFrame:
    """The line evaluated at evenly spaced waits from the shortest to the longest."""
    return (
        trend(visits)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / F.lit(points - 1))
        .select("point", F.col("x").alias("wait_time"), (F.col("intercept") + F.col("slope") * F.col("x")).alias("score"))
    )


def _fences(quartiles: DataFrame) -> DataFrame:
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return quartiles.select(
        q1.alias("q1"),
        q3.alias("q3"),
        (q1 - FENCE * (q3 - q1)).alias("lower_bound"),
        (q3 + FENCE * (q3 - q1)).alias("upper_bound"),
    )


def _bounds(counts: DataFrame, column: str) -> DataFrame:
    probs = F.array(F.lit(0.25), F.lit(0.75))
    return _fences(counts.agg(F.percentile(column, probs, F.col("n")).alias("q")))


def wait_bounds(visits: DataFrame, accuracy: float | None = None) -> DataFrame:
    """Quartiles of the wait and the bounds beyond which a wait is an anomaly: one row.

    ``accuracy``: as in :func:`wait_summary`.
    """
    if accuracy:
        return _fences(sketched(visits, "wait_time", [0.25, 0.75], accuracy))
    return _bounds(value_counts(visits, "wait_time"), "wait_time")


def _bound_pair(bounds: DataFrame) -> tuple[Column, Column]:
    pair = bounds.select(F.struct("lower_bound", "upper_bound").alias("b")).scalar()
    return pair.getField("lower_bound"), pair.getField("upper_bound")


def anomalies(visits: DataFrame, accuracy: float | None = None) -> DataFrame:
    """Visits whose wait lies outside the bounds, with ``anomaly_type``."""
    lower, upper = _bound_pair(wait_bounds(visits, accuracy))
    wait = F.col("wait_time")
    return visits.where((wait < lower) | (wait > upper)).withColumn(
        "anomaly_type", F.when(wait > upper, "High Wait").otherwise("Unusually Low Wait")
    )


def anomaly_summary(visits: DataFrame, accuracy: float | None = None) -> DataFrame:
    """Bounds, number and percentage of anomalies; needs only the distribution of waits, one scan (with ``accuracy``, two)."""
    if accuracy:
        counts, bounds = visits.select("wait_time", F.lit(1).cast("bigint").alias("n")), wait_bounds(visits, accuracy)
    else:
        counts = value_counts(visits, "wait_time", keep_null=True)
        bounds = _bounds(counts, "wait_time")
    lower, upper = _bound_pair(bounds)
    outside = (F.col("wait_time") < lower) | (F.col("wait_time") > upper)
    return counts.agg(
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0).cast("bigint")).alias("n_anomalies"),
        F.sum("n").alias("total"),
    ).select(
        lower.alias("lower_bound"),
        upper.alias("upper_bound"),
        "n_anomalies",
        percent(F.col("n_anomalies"), F.col("total")).alias("pct_anomalies"),
    )


def anomaly_list(visits: DataFrame, n: int = 30) -> DataFrame:
    """The first anomalies by id, for display."""
    return anomalies(visits).orderBy("patient_id", "wait_time").limit(n).select(*_ANOMALY_COLUMNS)


def anomaly_scatter(visits: DataFrame) -> DataFrame:
    """Every visit with date, wait and whether its patient id is among the anomalies.

    The mark goes by id: all visits of an id are marked when one of them is an anomaly.
    """
    rows = visits.select("patient_id", "admission_date", "wait_time")
    marked = mark_members(rows, anomalies(rows), "patient_id", "hit")
    return marked.select(
        "patient_id", "admission_date", "wait_time",
        F.when(F.col("hit"), "Anomaly").otherwise("Normal").alias("status"),
    )


def visits_of_anomalous_ids(visits: DataFrame) -> DataFrame:
    """All visits of the ids that have an anomaly."""
    return members_only(visits, anomalies(visits.select("patient_id", "wait_time")), "patient_id")


def profile(visits: DataFrame) -> DataFrame:
    """Per column: position, type, number and percentage of missing values; plus the size of the table."""
    names = visits.columns
    total, missing = F.count(F.lit(1)).alias("n_rows"), [F.count_if(F.col(c).isNull()).alias(c) for c in names]
    types = F.create_map(*[F.lit(x) for name, kind in visits.dtypes for x in (name, kind)])
    long = visits.agg(total, *missing).unpivot(["n_rows"], names, "column", "missing")
    return long.select(
        "column",
        types[F.col("column")].alias("type"),
        "missing",
        half_even(percent(F.col("missing"), F.col("n_rows"))).alias("missing_pct"),
        "n_rows",
        F.lit(len(names)).alias("n_columns"),
    )
