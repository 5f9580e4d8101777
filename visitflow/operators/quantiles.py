"""Quantiles and moments: exact ones from value counts, others from mergeable sketches.

``percentile`` on raw rows keeps one value map per task and merges all of them in a single reducer. Here the rows are
first reduced to (value, count) by an ordinary hash aggregate, which combines on the map side and spreads over
reducers, so the last step sees one row per distinct value: a few hundred for minutes, ages and scores, whatever the
size of the table and however often one value occurs. A continuous column has as many values as rows; for such columns
the operators take an ``accuracy``, the largest error in rank, and read quantiles from sketches instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, by: Sequence[str] = (), keep_null: bool = False) -> DataFrame:
    """Rows of ``(*by, column, n)``."""
    if not keep_null:
        df = df.where(F.col(column).isNotNull())
    return df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))


def quantiles(counts: DataFrame, column: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolation quantiles of weighted values, as an array column ``q`` per group."""
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    return counts.groupBy(*by).agg(F.percentile(column, probs, F.col("n")).alias("q"))


def median(df: DataFrame, column: str) -> Column:
    """The exact median as a scalar subquery, usable in any projection or filter."""
    counts = value_counts(df, column)
    return counts.agg(F.percentile(column, F.lit(0.5), F.col("n")).alias("m")).scalar()


def sketch_size(error: float) -> int:
    """Size of a KLL sketch whose quantiles are at most ``error`` off in rank (a share of the rows) in 99 of 100 cases."""
    return min(65_535, max(8, ceil((2.296 / error) ** (1 / 0.9021))))


def sketched(
    df: DataFrame, column: str, probabilities: Sequence[float], error: float, by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles ``q`` per group from mergeable sketches: of a size that ``error`` alone decides, combined before the shuffle.

    For continuous columns, where nearly every value is distinct and value counts would be as many as the rows. The
    values are rows' own values, not interpolated; without rows, ``q`` is null. Sketches toss coins: two runs may differ, each
    within the error.
    """
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    known = F.col(column).cast("double")
    found = df.where(F.col(column).isNotNull()).groupBy(*by).agg(
        F.kll_sketch_agg_double(known, sketch_size(error)).alias("s"), F.count(F.lit(1)).alias("rows"))
    return found.select(*by, F.when(F.col("rows") > 0, F.kll_sketch_get_quantile_double("s", probs)).alias("q"))


def medians(df: DataFrame, columns: Sequence[str], accuracy: float | None = None) -> Column:
    """Medians of several columns in one pass: a scalar map from column name to median. Exact, or by sketches."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "feature", "value"
    )
    if accuracy:
        per_feature = sketched(long, "value", [0.5], accuracy, ["feature"]).select("feature", F.col("q")[0].alias("m"))
    else:
        counts = value_counts(long, "value", by=["feature"])
        per_feature = counts.groupBy("feature").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("m"))
    return per_feature.agg(F.map_from_entries(F.collect_list(F.struct("feature", "m"))).alias("medians")).scalar()


def weighted_moments(counts: DataFrame, column: str) -> DataFrame:
    """One row ``count, mean, std`` of weighted values; the deviations are taken from the mean, not from a square sum."""
    value, n = F.col(column).cast("double"), F.col("n")
    mean = counts.agg(F.try_divide(F.sum(value * n), F.sum(n)).alias("mean")).scalar()
    return counts.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"),
        F.try_divide(F.sum(value * n), F.sum(n)).alias("mean"),
        F.sqrt(F.try_divide(F.sum(n * (value - mean) * (value - mean)), F.sum(n) - 1)).alias("std"),
    )
