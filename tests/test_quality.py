from datetime import date

import pytest

from visitflow.operators import quality
from visitflow.operators.derive import derive
from visitflow.sources import schema as S

GOOD = ("A", date(2020, 1, 2), "10:00:00", "N", "Male", 30, "R", "None", "Admission", 5.0, 10)


def table(spark, *changes):
    rows = [tuple({**dict(zip(S.RAW_COLUMNS, GOOD)), **change}.values()) for change in changes]
    return derive(spark.createDataFrame(rows, S.BASE))


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"age": -1}, "age_not_negative"),
        ({"age": 121}, "age_plausible"),
        ({"satisfaction_score": 11.0}, "score_in_range"),
        ({"wait_time": -5}, "wait_not_negative"),
        ({"admission_time": "24:00:00"}, "hour_in_range"),
        ({"admission_date": None}, "admission_date_present"),
        ({"admission_flag": "X"}, "admission_flag_allowed"),
        ({"patient_id": None}, "patient_id_present"),
    ],
)
def test_each_rule(spark, change, rule):
    valid, quarantine, summary = quality.check(table(spark, {"patient_id": "B"}, {"patient_id": "C", **change}))
    assert {r["rule"]: r["violations"] for r in summary.collect() if r["violations"]} == {rule: 1}
    assert [r[quality.VIOLATIONS] for r in quarantine.collect()] == [[rule]]
    assert valid.count() == 1 and quality.VIOLATIONS not in valid.columns


def test_missing_values_pass_range_rules(spark):
    rows = table(spark, {"age": None, "satisfaction_score": None, "wait_time": None, "admission_time": None})
    assert quality.check(rows)[1].isEmpty()


def test_repeated_ids(spark):
    rows = table(spark, {}, {}, {}, {"patient_id": "B"}, {"patient_id": None})
    assert [tuple(r) for r in quality.duplicate_ids(rows).collect()] == [("A", 3)]
    counts = {r["rule"]: r["violations"] for r in quality.summary(rows).collect()}
    assert counts["patient_id_unique"] == 2


def test_empty_rows_and_shape(spark):
    rows = table(spark, {}, {c: None for c in S.RAW_COLUMNS if c != "department_referral"})
    row = quality.shape(rows).first()
    assert (row["n_rows"], row["empty_rows"], row["min_age"]) == (2, 1, 30)
    broken = [r[quality.VIOLATIONS] for r in quality.check(rows)[1].collect()]
    assert "row_not_empty" in broken[0]


def test_missing_columns(spark):
    assert quality.missing_columns(table(spark, {}).drop("race", "age")) == ["age", "race"]
