"""Reproducible samples and splits by the rank of a hash.

Every visit gets the MD5 of seed and id; a sample or a test set is the rows up to some rank in that order. Ranking all
rows with a window would sort each class in one task, and a global top-k would send k rows of every input partition to
one task. Both are replaced by *cut-offs*: the hash value that sits at the wanted rank, found from a histogram of hash
prefixes, a finer histogram inside the prefix that holds the rank, and a look at the few rows left. The visits
themselves are then only compared with the cut-off: no shuffle, no sort. Visits that share an id share the hash and stay
on one side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A rank is searched in the one of 4,096 prefixes that holds it, there in the one of 65,536 parts that holds it, and
# only then row by row.
PREFIX_DIGITS = 3
PART_DIGITS = 4


def hash_key(seed: int, column: str = "patient_id") -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(column)))


def share_rank(fraction: float):
    """Rank that closes the given share of a class, rounded up."""
    return lambda total: F.ceil(F.round(total * fraction, 6))


def first_rank(n: int):
    """The n-th rank, or the last one when there are fewer rows."""
    return lambda total: F.least(F.lit(n).cast("bigint"), total)


def cutoffs(df: DataFrame, key: Column, ranks: Sequence, stratum: Column | None = None) -> Column:
    """Hash values at the given ranks, as a scalar map ``stratum -> array of hashes`` (one entry per rank).

    ``ranks`` are functions from a stratum's row count to a rank. The windows run over histograms of at most 4,096 and
    65,536 rows.
    """
    strata = F.lit("all") if stratum is None else stratum.cast("string")
    hashed = df.select(strata.alias("stratum"), key.alias("key")).withColumn(
        "prefix", F.substring("key", 1, PREFIX_DIGITS)
    )
    histogram = hashed.groupBy("stratum", "prefix").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("stratum").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum")
    placed = histogram.select(
        "stratum", "prefix", "n", F.sum("n").over(running).alias("upto"), F.sum("n").over(whole).alias("total")
    )
    wanted = F.array(
        *[F.struct(F.lit(i).alias("slot"), rank(F.col("total")).cast("bigint").alias("rank"))
          for i, rank in enumerate(ranks)]
    )
    edges = (
        placed.select("stratum", "prefix", "n", "upto", F.inline(wanted))
        .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select("stratum", "prefix", "slot", (F.col("rank") - F.col("upto") + F.col("n")).alias("offset"))
    )
    # One edge row per stratum and rank: small by construction, so the joins with edges may broadcast.
    inside = (
        hashed.join(F.broadcast(edges), ["stratum", "prefix"])
        .groupBy("stratum", "slot", "offset", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("part", F.substring("key", PREFIX_DIGITS + 1, PART_DIGITS))
    )
    parts = inside.groupBy("stratum", "slot", "offset", "part").agg(F.sum("n").alias("n"))
    by_part = Window.partitionBy("stratum", "slot").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    part_edges = (
        parts.withColumn("upto", F.sum("n").over(by_part))
        .where((F.col("offset") <= F.col("upto")) & (F.col("offset") > F.col("upto") - F.col("n")))
        .select("stratum", "slot", "part", (F.col("offset") - F.col("upto") + F.col("n")).alias("left"))
    )
    by_key = Window.partitionBy("stratum", "slot").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        inside.join(F.broadcast(part_edges), ["stratum", "slot", "part"])
        .withColumn("upto", F.sum("n").over(by_key))
        .where(F.col("upto") >= F.col("left"))
        .groupBy("stratum", "slot")
        .agg(F.min("key").alias("key"))
    )
    arrays = found.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("slot", "key"))).alias("cuts"))
    return arrays.agg(
        F.map_from_entries(F.collect_list(F.struct("stratum", F.col("cuts.key").alias("cuts")))).alias("cutoffs")
    ).scalar()


def with_test_flag(
    df: DataFrame, seed: int = 42, test_share: float = 0.2, label: str | None = None
) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(test_share * n)`` rows, of each label when one is given."""
    key = hash_key(seed)
    stratum = F.lit("all") if label is None else F.col(label).cast("string")
    cuts = cutoffs(df, key, [share_rank(test_share)], None if label is None else F.col(label))
    return df.withColumn("_cuts", cuts).withColumn(
        "is_test", F.coalesce(key <= F.col("_cuts")[stratum][0], F.lit(False))
    ).drop("_cuts")


def with_fold(df: DataFrame, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` in ``0..folds-1``: equal parts of every label, by hash rank."""
    key = hash_key(seed)
    cuts = cutoffs(df, key, [share_rank(i / folds) for i in range(1, folds)], F.col(label))
    bound = df.withColumn("_own", cuts[F.col(label).cast("string")]).withColumn("_key", key)
    passed = [F.coalesce((F.col("_key") > F.col("_own")[i]).cast("int"), F.lit(0)) for i in range(folds - 1)]
    return bound.withColumn("fold", sum(passed[1:], passed[0])).drop("_own", "_key")


def sample_exact(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``min(n, rows)`` rows of lowest hash, whole rows."""
    key = hash_key(seed)
    cuts = cutoffs(df, key, [first_rank(n)])
    near = df.where(key <= cuts[F.lit("all")][0])
    return near.orderBy(key, "patient_id").limit(n)


def split(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` by :func:`with_test_flag`."""
    flagged = with_test_flag(df, **options)
    return flagged.where(~F.col("is_test")).drop("is_test"), flagged.where("is_test").drop("is_test")
