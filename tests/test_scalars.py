from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from visitflow.functions import numeric, scalars
from visitflow.operators.derive import derive, parse, relabel_time_of_day, sql_view
from visitflow.sources import schema as S


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def mapped(spark, values, kind, function):
    return [r[0] for r in column(spark, values, kind).select(function(F.col("x"))).collect()]


def test_age_groups_are_open_on_the_left(spark):
    ages = [0, 1, 12, 13, 17, 18, 35, 36, 50, 51, 65, 66, 120, 121, None]
    child, teen, young, adult, middle, senior = S.AGE_GROUPS
    expected = [None, child, child, teen, teen, young, young, adult, adult, middle, middle, senior, senior, None, None]
    assert mapped(spark, ages, "int", scalars.age_group) == expected


def test_time_of_day(spark):
    hours = [0, 5, 6, 11, 12, 17, 18, 23, None]
    t = S.TIME_OF_DAY
    expected = [t["night"]] * 2 + [t["morning"]] * 2 + [t["afternoon"]] * 2 + [t["evening"]] * 2 + [t["unknown"]]
    assert mapped(spark, hours, "int", scalars.time_of_day) == expected
    short = mapped(spark, hours, "int", lambda h: scalars.time_of_day(h, S.TIME_OF_DAY_SHORT))
    assert short == ["Night"] * 2 + ["Morning"] * 2 + ["Afternoon"] * 2 + ["Evening"] * 2 + ["Unknown"]


def test_the_two_wait_bucketings_differ_at_zero_and_null(spark):
    waits = [0, 20, 21, 40, 41, 60, 61, 999, 1000, None]
    short, moderate, long, very_long = S.WAIT_CATEGORIES
    assert mapped(spark, waits, "int", scalars.wait_category) == [
        None, short, moderate, moderate, long, long, very_long, very_long, None, None,
    ]
    buckets = Counter(mapped(spark, waits, "int", scalars.wait_bucket))
    assert [buckets[b] for b in S.WAIT_BUCKETS] == [2, 2, 2, 4]


def test_rounding_ties(spark):
    assert mapped(spark, [0.125], "double", numeric.half_even) == [0.12]
    assert mapped(spark, [0.125], "double", numeric.half_up) == [0.13]


def test_number_text(spark):
    assert mapped(spark, [49.62, 0.25, None], "double", lambda x: numeric.as_text(x, 1, "%", "N/A")) == [
        "49.6%", "0.2%", "N/A",
    ]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("03/07/2020", date(2020, 3, 7)), ("3/7/2020", date(2020, 3, 7)), ("13/40/2020", None), ("bad", None),
     (None, None)],
)
def test_dates(spark, text, expected):
    assert mapped(spark, [text], "string", scalars.visit_date) == [expected]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("8:05:09 PM", "20:05:09"), ("12:00:00 AM", "00:00:00"), ("08:05:09 pm", "20:05:09"), ("12:30:00 PM", "12:30:00"),
     ("bad", None), ("", None), (None, None)],
)
def test_times(spark, text, expected):
    assert mapped(spark, [text], "string", scalars.visit_time) == [expected]


def test_iso_week(spark):
    weeks = mapped(spark, [date(2021, 1, 1), date(2021, 1, 4), None], "date", scalars.iso_week)
    assert weeks == [53, 1, 0]


def raw_row(spark, department):
    values = ("A", "01/02/2020", "1:00:00 PM", "N", "Male", 5, "R", department, None, None, None, None)
    return spark.createDataFrame([values], S.RAW)


@pytest.mark.parametrize(
    ("mode", "text", "department", "referred"),
    [("literal", "None", "None", False), ("literal", None, "None", False), ("literal", "Cardio", "Cardio", True),
     ("null", "None", None, True), ("null", "Cardio", "Cardio", True)],
)
def test_the_word_none(spark, mode, text, department, referred):
    row = derive(parse(raw_row(spark, text), mode), mode).first()
    assert (row["department_referral"], row["has_referral"]) == (department, referred)
    assert row["is_admitted"] is False  # a missing flag is not an admission


def test_unknown_referral_mode(spark):
    with pytest.raises(ValueError, match="referral_null_mode"):
        parse(raw_row(spark, "None"), "other")


def test_relabel_and_sql_flags(spark):
    visits = derive(parse(raw_row(spark, "None")))
    assert relabel_time_of_day(visits, S.TIME_OF_DAY_SHORT).first()["time_of_day"] == "Afternoon"
    row = sql_view(visits).first()
    assert (row["is_admitted"], row["has_referral"]) == (0, 0)


def test_category_order(spark):
    places = mapped(spark, ["Monday", "Sunday", "x", None], "string", lambda c: scalars.in_order(c, S.WEEKDAYS))
    assert places == [1, 7, 0, 0]
