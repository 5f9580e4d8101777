"""The statistical report: every section a frame, written as Parquet or CSV."""

from __future__ import annotations

import argparse
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from visitflow.operators import kpis, stats
from visitflow.plans.adhoc import report_queries
from visitflow.sources.files import keep, read_visits


def statistical_report(visits: DataFrame) -> dict[str, DataFrame]:
    """Section name to lazy frame."""
    return {
        "overview": stats.profile(visits),
        "admission_overall": kpis.overall_admission_rate(visits),
        "admission_rates": kpis.admission_rates(visits),
        "wait_summary": stats.wait_summary(visits),
        "wait_means": kpis.mean_waits(visits),
        "wait_t_test": stats.wait_t_test(visits),
        "score_summary": kpis.score_summary(visits),
        "score_means": kpis.mean_scores(visits),
        "score_wait_correlation": stats.score_wait_correlation(visits),
        **report_queries(visits),
    }


def write_sections(sections: Mapping[str, DataFrame], target: str, form: str = "parquet") -> dict[str, int]:
    """One folder per section; adaptive execution merges the partitions of a small section into one ordered file.

    Returns the rows of each section, counted while it is written. A manifest is written last; until then the target's
    says that the report is being written, so a report that broke off is recognised (:func:`read_manifest`).
    """
    rows: dict[str, int] = {}
    if not sections:
        return rows
    spark = next(iter(sections.values())).sparkSession
    _write_manifest(spark, target, form, sections, rows, complete=False)
    for name, frame in sections.items():
        seen = Observation(name)
        counted = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
        counted.write.mode("overwrite").format(form).option("header", True).save(f"{target}/{name}")
        rows[name] = seen.get["rows"]
    _write_manifest(spark, target, form, sections, rows, complete=True)
    return rows


MANIFEST = "manifest"


def _write_manifest(
    spark: SparkSession, target: str, form: str, sections: Mapping[str, DataFrame], rows: Mapping[str, int], complete: bool
) -> None:
    entries = [(name, form, frame.columns, rows.get(name), complete) for name, frame in sections.items()]
    schema = "section string, format string, columns array<string>, rows bigint, complete boolean"
    spark.createDataFrame(entries, schema).coalesce(1).write.mode("overwrite").json(f"{target}/{MANIFEST}")


def read_manifest(spark: SparkSession, target: str) -> dict[str, int] | None:
    """Sections and their rows; None for a report that is being written or broke off."""
    schema = "section string, format string, columns array<string>, rows bigint, complete boolean"
    try:
        entries = spark.read.schema(schema).json(f"{target}/{MANIFEST}").collect()
    except AnalysisException:
        return None
    if not entries or not all(e["complete"] for e in entries):
        return None
    return {e["section"]: e["rows"] for e in entries}


def main() -> None:
    parser = argparse.ArgumentParser(description="Write the statistical report of a visit table.")
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--source-format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--format", default="parquet", choices=["csv", "parquet"])
    args = parser.parse_args()
    spark = SparkSession.builder.appName("visitflow-report").getOrCreate()
    # Every section reads the table; the source is parsed once.
    visits = keep(read_visits(spark, args.source, args.source_format))
    try:
        write_sections(statistical_report(visits), args.target, args.format)
    finally:
        visits.unpersist()


if __name__ == "__main__":
    main()
