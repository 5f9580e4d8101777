"""Data-quality rules: row checks, uniqueness of the id, and the shape of the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from visitflow.sources import schema as S

VIOLATIONS = "violations"


@dataclass(frozen=True)
class Rule:
    """A named condition a row must meet. Like a table constraint, it passes where it evaluates to null."""

    name: str
    predicate: Column

    @property
    def broken(self) -> Column:
        return F.coalesce(~self.predicate, F.lit(False))


def _nothing_set() -> Column:
    # The department has a default and the flag of a blank line is null, so the other columns decide.
    columns = [c for c in S.RAW_COLUMNS if c != "department_referral"]
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull()


def rules() -> list[Rule]:
    """Constraints of the visit table and the checks of the dataset validation."""
    age, score, wait, hour = (F.col(c) for c in ("age", "satisfaction_score", "wait_time", "hour"))
    return [
        Rule("patient_id_present", F.col("patient_id").isNotNull()),
        Rule("admission_date_present", F.col("admission_date").isNotNull()),
        Rule("admission_flag_present", F.col("admission_flag").isNotNull()),
        Rule("admission_flag_allowed", F.col("admission_flag").isin(S.ADMITTED, S.NOT_ADMITTED)),
        Rule("age_not_negative", age >= 0),
        Rule("age_plausible", age <= S.AGE_BINS[-1]),
        Rule("score_in_range", score.between(0, 10)),
        Rule("wait_not_negative", wait >= 0),
        Rule("hour_in_range", hour.between(0, 23)),
        Rule("row_not_empty", ~_nothing_set()),
    ]


def malformed_rule() -> Rule:
    """For rows straight from a raw file."""
    return Rule("record_well_formed", F.col(S.MALFORMED).isNull())


def with_violations(visits: DataFrame, checks: Sequence[Rule] | None = None) -> DataFrame:
    """Add the names of the rules each row breaks."""
    checks = rules() if checks is None else checks
    names = F.array(*[F.when(r.broken, F.lit(r.name)) for r in checks])
    return visits.withColumn(VIOLATIONS, F.filter(names, lambda name: name.isNotNull()))


def duplicate_ids(visits: DataFrame) -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    return (
        visits.where(F.col("patient_id").isNotNull())
        .groupBy("patient_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
    )


def summary(visits: DataFrame, checks: Sequence[Rule] | None = None) -> DataFrame:
    """Number of violations per rule; a repeated id counts once for each row after the first."""
    checks = rules() if checks is None else checks
    counted = visits.agg(*[F.count_if(r.broken).alias(r.name) for r in checks])
    per_rule = counted.unpivot([], [r.name for r in checks], "rule", "violations")
    return per_rule.unionByName(_repeated(visits))


def _repeated(visits: DataFrame) -> DataFrame:
    repeated = duplicate_ids(visits).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations"))
    return repeated.select(F.lit("patient_id_unique").alias("rule"), "violations")


def observed(visits: DataFrame, seen: Observation, checks: Sequence[Rule] | None = None) -> DataFrame:
    """The same rows; ``seen`` counts the violations of each rule while they pass, in whatever job reads them."""
    checks = rules() if checks is None else checks
    return visits.observe(seen, *[F.count_if(r.broken).alias(r.name) for r in checks])


def summary_of(counts: Mapping[str, int], visits: DataFrame) -> DataFrame:
    """:func:`summary` from observed counts; of the visits, only ids are read."""
    frame = visits.sparkSession.createDataFrame(list(counts.items()), "rule string, violations bigint")
    return frame.unionByName(_repeated(visits))


def check(visits: DataFrame, checks: Sequence[Rule] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(valid, quarantine, summary)``: rows that break no row rule, rows that do, and the counts."""
    marked = with_violations(visits, checks)
    clean = F.size(VIOLATIONS) == 0
    return marked.where(clean).drop(VIOLATIONS), marked.where(~clean), summary(visits, checks)


def missing_columns(visits: DataFrame, required: Sequence[str] = S.RAW_COLUMNS) -> list[str]:
    """Required columns the table does not have."""
    return [c for c in required if c not in visits.columns]


def shape(visits: DataFrame) -> DataFrame:
    """One row: rows, columns, rows without any value, youngest and oldest age."""
    return visits.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(visits.columns)).alias("n_columns"),
        F.count_if(_nothing_set()).alias("empty_rows"),
        F.min("age").alias("min_age"),
        F.max("age").alias("max_age"),
    )
