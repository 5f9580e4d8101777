"""From a raw file to the checked, partitioned visit table."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from visitflow.operators import quality
from visitflow.operators.derive import derive, fill_scores, parse
from visitflow.sources import schema as S
from visitflow.sources.files import read_raw_csv, write_parquet

QUARANTINED = "quarantined"  # a partition column, so it reads back as the text true or false


def ingest(spark: SparkSession, source: str, target: str, referral_null_mode: str = "literal") -> DataFrame:
    """Parse, derive, check and write raw CSV in one pass; returns the rule summary of what was written.

    Good and bad rows go to one table, split by the partition column ``quarantined``, so the text is parsed once.
    """
    checks = [*quality.rules(), quality.malformed_rule()]
    visits = derive(parse(read_raw_csv(spark, source), referral_null_mode), referral_null_mode)
    marked = quality.with_violations(visits, checks).withColumn(QUARANTINED, F.size(quality.VIOLATIONS) > 0)
    seen = Observation("rules")  # row rules are counted while the rows are written; only ids are read again
    write_parquet(quality.observed(marked, seen, checks), target, QUARANTINED)
    return quality.summary_of(seen.get, spark.read.parquet(target))


def read_valid(spark: SparkSession, target: str) -> DataFrame:
    """The rows that broke no rule, with scores filled."""
    rows = spark.read.parquet(target).where(F.col(QUARANTINED) == "false")
    return fill_scores(rows.drop(QUARANTINED, quality.VIOLATIONS, S.MALFORMED)).select(*S.ALL_COLUMNS)


def read_quarantine(spark: SparkSession, target: str) -> DataFrame:
    """The rows that broke a rule, with the rules' names and, for unreadable lines, their text."""
    return spark.read.parquet(target).where(F.col(QUARANTINED) == "true")


def main() -> None:
    parser = argparse.ArgumentParser(description="Ingest a raw visit file.")
    parser.add_argument("source")
    parser.add_argument("target")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("visitflow-ingest").getOrCreate()
    ingest(spark, args.source, args.target).show(truncate=False)


if __name__ == "__main__":
    main()
