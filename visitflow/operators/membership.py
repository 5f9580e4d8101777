"""Mark rows whose key occurs in another frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _members(keys: DataFrame, key: str) -> DataFrame:
    return keys.where(F.col(key).isNotNull()).select(F.col(key).alias("_member"))


def mark_members(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a boolean ``flag``: does the row's key occur in ``keys``?

    One left join with the distinct keys. Whether they are broadcast is Spark's choice, by their size, and a hot key of
    a sort-merge join is split by adaptive execution.
    """
    joined = df.join(_members(keys, key).distinct(), F.col(key) == F.col("_member"), "left")
    return joined.select(*df.columns, F.col("_member").isNotNull().alias(flag))


def members_only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``; a semi join, which adaptive execution can split on a hot key."""
    return df.join(_members(keys, key), F.col(key) == F.col("_member"), "left_semi")
