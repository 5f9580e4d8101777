"""The visit table: column names, types and ordered categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------------------------------
# Columns of the raw file, bound by position.
RAW_COLUMNS = (
    "patient_id", "admission_date", "admission_time", "patient_name", "gender", "age", "race",
    "department_referral", "admission_flag", "satisfaction_score", "wait_time",
)

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Bins are open on the left and closed on the right.
AGE_BINS = (0, 12, 17, 35, 50, 65, 120)
AGE_GROUPS = (
    "Child (0-12)", "Teen (13-17)", "Young Adult (18-35)", "Adult (36-50)", "Middle Age (51-65)", "Senior (65+)",
)

WAIT_BINS = (0, 20, 40, 60, 999)
WAIT_CATEGORIES = ("Short (<20 min)", "Moderate (20-40 min)", "Long (40-60 min)", "Very Long (60+ min)")

# Buckets of the satisfaction-by-wait query, which has its own edges and labels.
WAIT_BUCKETS = ("0–20 min", "21–40 min", "41–60 min", "60+ min")

# Unknown, morning from 6, afternoon from 12, evening from 18, otherwise night.
TIME_OF_DAY = {
    "unknown": "Unknown", "morning": "Morning (6–12)", "afternoon": "Afternoon (12–18)",
    "evening": "Evening (18–24)", "night": "Night (0–6)",
}
TIME_OF_DAY_SHORT = {
    "unknown": "Unknown", "morning": "Morning", "afternoon": "Afternoon", "evening": "Evening", "night": "Night",
}

ADMITTED = "Admission"
NOT_ADMITTED = "Not Admission"
NO_REFERRAL = "None"

DATE_PATTERN = "M/d/yyyy"
TIME_PATTERN = "h:mm:ss a"

# Columns of the record browser.
BROWSE_COLUMNS = (
    "patient_id", "admission_date", "gender", "age", "race", "department_referral", "admission_flag", "wait_time",
    "satisfaction_score", "time_of_day", "age_group",
)
# --- end of fixed values ------------------------------------------------------------------------------------------

MALFORMED = "malformed_record"

_NUMBERS = {"age": T.IntegerType(), "wait_time": T.IntegerType(), "satisfaction_score": T.DoubleType()}

# What the file reader sees: every field is text, and a row that is short or long lands in MALFORMED.
RAW_TEXT = T.StructType([T.StructField(c, T.StringType()) for c in (*RAW_COLUMNS, MALFORMED)])

# A raw row after the numbers were read; dates and times are still text.
RAW = T.StructType(
    [T.StructField(c, _NUMBERS.get(c, T.StringType())) for c in RAW_COLUMNS]
    + [T.StructField(MALFORMED, T.StringType())]
)

# The parsed table before derivation.
BASE = T.StructType([
    T.StructField(c, T.DateType() if c == "admission_date" else _NUMBERS.get(c, T.StringType()))
    for c in RAW_COLUMNS
])

# Derived column -> the base column it is computed from.
DERIVED_FROM = {
    "year": "admission_date", "month": "admission_date", "month_name": "admission_date",
    "day_of_week": "admission_date", "week_number": "admission_date", "hour": "admission_time",
    "time_of_day": "admission_time", "age_group": "age", "wait_category": "wait_time",
    "is_admitted": "admission_flag", "satisfaction_score_filled": "satisfaction_score",
    "has_referral": "department_referral",
}

ALL_COLUMNS = RAW_COLUMNS + tuple(DERIVED_FROM)


def category_frame(spark: SparkSession, labels: tuple[str, ...], name: str) -> DataFrame:
    """The labels of an ordered category with their rank, as an inline table of ``len(labels)`` rows."""
    rows = ", ".join(f"('{label}', {rank})" for rank, label in enumerate(labels))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS category({name}, rank)")
