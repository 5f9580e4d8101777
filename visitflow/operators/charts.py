"""The data behind each chart. Drawing is left to the caller.

Frames are small: groups, bins, grid points or an exact sample. Distributions start from value counts, so a chart of
any table costs one aggregation by the plotted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitflow.functions.numeric import share
from visitflow.functions.scalars import in_order
from visitflow.operators import stats
from visitflow.operators.quantiles import quantiles, sketched, value_counts
from visitflow.operators.sampling import sample_exact
from visitflow.sources import schema as S

_COUNT = "count"


def _counts(visits: DataFrame, *keys: str) -> DataFrame:
    """Visits per key; rows with a missing key are left out."""
    return visits.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(_COUNT))


def daily_volume(visits: DataFrame) -> DataFrame:
    return _counts(visits, "admission_date").orderBy("admission_date")


def admission_status(visits: DataFrame) -> DataFrame:
    return _counts(visits, "admission_flag").orderBy(F.desc(_COUNT), "admission_flag")


def monthly_volume(visits: DataFrame) -> DataFrame:
    return _counts(visits, "year", "month", "month_name").orderBy("year", "month")


def gender_counts(visits: DataFrame) -> DataFrame:
    return _counts(visits, "gender").orderBy(F.desc(_COUNT), "gender")


def race_counts(visits: DataFrame) -> DataFrame:
    return _counts(visits, "race").orderBy(F.desc(_COUNT), "race")


def age_group_by_status(visits: DataFrame) -> DataFrame:
    return _counts(visits, "age_group", "admission_flag").orderBy(
        in_order(F.col("age_group"), S.AGE_GROUPS), "admission_flag"
    )


def hourly_volume(visits: DataFrame) -> DataFrame:
    return _counts(visits, "hour").orderBy("hour")


def weekday_volume(visits: DataFrame) -> DataFrame:
    return _counts(visits, "day_of_week").orderBy(in_order(F.col("day_of_week"), S.WEEKDAYS))


def _department_measure(visits: DataFrame, measure: Column, name: str) -> DataFrame:
    return (
        visits.where(F.col("department_referral").isNotNull())
        .groupBy("department_referral")
        .agg(measure.alias(name))
        .orderBy(name, "department_referral")
    )


def department_counts(visits: DataFrame) -> DataFrame:
    return _department_measure(visits, F.count(F.lit(1)), _COUNT)


def department_rates(visits: DataFrame) -> DataFrame:
    return _department_measure(visits, share(F.col("is_admitted")) * 100, "admission_rate")


def department_waits(visits: DataFrame) -> DataFrame:
    return _department_measure(visits, F.avg("wait_time"), "avg_wait")


def score_by_race(visits: DataFrame) -> DataFrame:
    return (
        visits.where(F.col("race").isNotNull())
        .groupBy("race")
        .agg(F.avg("satisfaction_score").alias("avg_score"))
        .where(F.col("avg_score").isNotNull())
        .orderBy("avg_score", "race")
    )


def histogram(visits: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """At most ``bins`` equal bins of whole-number width, closed on the left, from the rounded-down minimum."""
    counts = value_counts(visits.dropna(subset=list(by)) if by else visits, column, by)
    low = F.floor(F.min(column))
    frame = counts.agg(
        F.struct(low.alias("low"), F.ceil((F.max(column) - low + 1) / bins).alias("width")).alias("f")
    ).scalar()
    low, width = F.col("_frame.low"), F.col("_frame.width")
    start = low + F.floor((F.col(column) - low) / width) * width
    return (
        counts.withColumn("_frame", frame).groupBy(*by, start.cast("bigint").alias("bin_start"))
        .agg(F.sum("n").alias(_COUNT))
        .orderBy(*by, "bin_start")
    )


def age_histogram(visits: DataFrame) -> DataFrame:
    return histogram(visits, "age", 30)


def wait_histogram(visits: DataFrame) -> DataFrame:
    return histogram(visits, "wait_time", 40, by=["admission_flag"])


def score_histogram(visits: DataFrame) -> DataFrame:
    """One bin per score point."""
    counts = value_counts(visits, "satisfaction_score")
    return (
        counts.groupBy(F.floor("satisfaction_score").cast("bigint").alias("bin_start"))
        .agg(F.sum("n").alias(_COUNT))
        .orderBy("bin_start")
    )


def _fenced(
    visits: DataFrame, value: str, group: str, labels: Sequence[str], accuracy: float | None = None
) -> DataFrame:
    """Value counts per label with the label's quartiles and fences; with an ``accuracy``, rows instead of counts."""
    known, probs = visits.where(F.col(group).isin(*labels)), [0.25, 0.5, 0.75]
    if accuracy:
        counts = known.where(F.col(value).isNotNull()).select(group, value, F.lit(1).cast("bigint").alias("n"))
        per_label = sketched(known, value, probs, accuracy, [group])
    else:
        counts = value_counts(known, value, [group])
        per_label = quantiles(counts, value, probs, [group])
    # One entry per label.
    by_label = per_label.agg(F.map_from_entries(F.collect_list(F.struct(group, "q"))).alias("q")).scalar()
    q = F.col("_q")
    reach = stats.FENCE * (q[2] - q[0])
    return counts.withColumn("_q", by_label[F.col(group)]).select(
        group, value, "n", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"),
        (q[0] - reach).alias("low_fence"), (q[2] + reach).alias("high_fence"),
    )


def box(
    visits: DataFrame, value: str, group: str, labels: Sequence[str], accuracy: float | None = None
) -> DataFrame:
    """Box summary per label: quartiles, whiskers (extreme values inside the fences) and number of outliers.

    ``accuracy``: the largest error of the quartiles in rank, for columns of very many values; without it they are exact.
    """
    v, n = F.col(value), F.col("n")
    inside = (v >= F.col("low_fence")) & (v <= F.col("high_fence"))
    return (
        _fenced(visits, value, group, labels, accuracy)
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.sum(n).alias(_COUNT),
            F.min(F.when(inside, v)).alias("low_whisker"),
            F.max(F.when(inside, v)).alias("high_whisker"),
            F.sum(F.when(inside, 0).otherwise(n)).alias("outliers"),
        )
        .orderBy(in_order(F.col(group), labels))
    )


def outlier_points(visits: DataFrame, value: str, group: str, labels: Sequence[str]) -> DataFrame:
    """The points a box plot draws beyond its whiskers: value and how many visits sit there."""
    v = F.col(value)
    return (
        _fenced(visits, value, group, labels)
        .where((v < F.col("low_fence")) | (v > F.col("high_fence")))
        .select(group, value, F.col("n").alias(_COUNT))
        .orderBy(in_order(F.col(group), labels), value)
    )


def wait_box_by_weekday(visits: DataFrame) -> DataFrame:
    return box(visits, "wait_time", "day_of_week", S.WEEKDAYS)


def wait_outliers_by_weekday(visits: DataFrame) -> DataFrame:
    return outlier_points(visits, "wait_time", "day_of_week", S.WEEKDAYS)


def age_box(visits: DataFrame) -> DataFrame:
    """Box summary of all ages (the margin of the age histogram)."""
    return box(visits.select("age", F.lit("all").alias("scope")), "age", "scope", ["all"])


def score_box_by_age_group(visits: DataFrame) -> DataFrame:
    return box(visits, "satisfaction_score", "age_group", S.AGE_GROUPS)


def score_outliers_by_age_group(visits: DataFrame) -> DataFrame:
    return outlier_points(visits, "satisfaction_score", "age_group", S.AGE_GROUPS)


TAIL = 4  # bandwidths


def score_density_by_age_group(visits: DataFrame, points: int = 101) -> DataFrame:
    """Gaussian kernel density of the score per age group on an even grid, the whole curve of a violin.

    Bandwidth by Silverman's rule, at least a hundredth of the range. The grid runs ``TAIL`` bandwidths past the lowest
    and the highest score, where the curve has come down to nothing. The sums run over distinct scores, not visits.
    """
    v, n, q = F.col("satisfaction_score"), F.col("n"), F.col("q")
    counts = value_counts(visits.where(F.col("age_group").isin(*S.AGE_GROUPS)), "satisfaction_score", ["age_group"])
    total, square = F.sum(v * n), F.sum(v * v * n)
    per_group = counts.groupBy("age_group").agg(
        F.sum(n).alias("size"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        # Scores lie in 0..10, so the sum of squares does not swamp the variance.
        F.sqrt(F.greatest(F.try_divide(square - total * total / F.sum(n), F.sum(n) - 1), F.lit(0.0))).alias("std"),
        F.percentile("satisfaction_score", F.array(F.lit(0.25), F.lit(0.75)), n).alias("q"),
    )
    rule = 1.059 * F.least(F.col("std"), (q[1] - q[0]) / 1.349) * F.pow(F.col("size"), F.lit(-0.2))
    per_group = per_group.withColumn("width", F.greatest(rule, (F.col("high") - F.col("low")) / 100))
    first, span = F.col("low") - TAIL * F.col("width"), F.col("high") - F.col("low") + 2 * TAIL * F.col("width")
    x = first + span * F.col("point") / F.lit(points - 1)
    kernel = F.exp(-0.5 * F.pow(F.try_divide(F.col("x") - v, F.col("width")), F.lit(2.0)))
    root = 2.5066282746310002  # square root of 2 pi
    return (
        counts.join(F.broadcast(per_group), "age_group")  # one row per age group
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
        .withColumn("x", x)
        .groupBy("age_group", "point", "x", "size", "width")
        .agg(F.sum(n * kernel).alias("mass"))
        .select(
            "age_group", "point", F.col("x").alias("satisfaction_score"),
            F.try_divide(F.col("mass"), F.col("size") * F.col("width") * root).alias("density"),
        )
        .orderBy(in_order(F.col("age_group"), S.AGE_GROUPS), "point")
    )


def weekday_hour_waits(visits: DataFrame) -> DataFrame:
    """Mean wait per weekday and hour, long form."""
    return (
        visits.dropna(subset=["day_of_week", "hour"])
        .groupBy("day_of_week", "hour")
        .agg(F.avg("wait_time").alias("avg_wait"))
    )


def wait_heatmap(visits: DataFrame) -> DataFrame:
    """Mean wait as a weekday by hour grid; all seven days in order, a day without visits is a row of nulls."""
    hours = list(range(24))
    known = visits.where(F.col("day_of_week").isin(*S.WEEKDAYS))
    grid = known.groupBy("day_of_week").pivot("hour", hours).agg(F.avg("wait_time"))
    days = S.category_frame(visits.sparkSession, S.WEEKDAYS, "day_of_week")
    return (
        days.join(F.broadcast(grid), "day_of_week", "left")  # at most seven rows
        .orderBy("rank")
        .select("day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])
    )


def score_wait_points(visits: DataFrame) -> DataFrame:
    """The scatter of score against wait: distinct points with their number of visits."""
    return _counts(visits, "wait_time", "satisfaction_score", "admission_flag")


def score_wait_visits(visits: DataFrame) -> DataFrame:
    """Every visit of that scatter."""
    scored = visits.where(F.col("satisfaction_score").isNotNull())
    return scored.select("patient_id", "wait_time", "satisfaction_score", "admission_flag")


def segment_scatter(clustered: DataFrame, n: int = 2000, seed: int = 42) -> DataFrame:
    """Wait and score of a sample of clustered visits; each row keeps its own cluster."""
    columns = ("patient_id", "wait_time", "satisfaction_score_filled", "cluster")
    return sample_exact(clustered.select(*columns), n, seed)


def quick_chart(result: DataFrame, n: int = 20) -> DataFrame | None:
    """Bars for any query result: its first non-numeric by its first numeric column, first rows only.

    None when there is no such pair or the result has fewer than two rows.
    """
    numeric = [f.name for f in result.schema if isinstance(f.dataType, T.NumericType)]
    other = [f.name for f in result.schema if not isinstance(f.dataType, T.NumericType)]
    if not numeric or not other or len(result.take(2)) < 2:
        return None
    return result.select(other[0], numeric[0]).limit(n)
