import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from visitflow.operators import quality
from visitflow.plans.ingest import ingest, read_quarantine, read_valid
from visitflow.sources import schema as S
from visitflow.sources.files import export_csv, keep, read_raw_csv, read_visits, save_table, write_parquet
from visitflow.sources.star import raw_text, visits

HEADER = "Id,Date,Time,Name,Gender,Age,Race,Department,Flag,Score,Wait"
LINES = [
    "P1,03/07/2020,08:05:09 AM,Ada,Female,30,R,Cardio,Admission,7,20",
    "P2,3/7/2020,8:05:09 PM,Bob,Male,40,R,None,Not Admission,,30",
    "P3,13/40/2020,12:00:00 AM,Cyd,Male,50,R,,Admission,3.5,40",
    "P4,04/01/2020,bad,Dan,Male,60,R,Cardio,Admission,,50",
    "P5,04/01/2020,,Eve,Female,70,R,Cardio,Admission,9,60",
    "P6,04/01/2020,08:05:09 pm,Fay,Female,xx,R,Cardio,Admission,9,60",
    "P7,04/01/2020,1:00:00 AM,Gus,Male,20,R,Cardio,Admission,9",
    "P8,04/01/2020,1:00:00 AM,Hal,Male,20,R,Cardio,Admission,9,10,extra",
    ",,,,,,,,,,",
    "P1,05/01/2020,1:00:00 AM,Ada,Female,31,R,Cardio,Admission,,15",
]


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


@pytest.fixture
def csv(folder):
    path = folder / "visits.csv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n")
    return str(path)


def by_id(df, *columns):
    return {r["patient_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_raw_csv_marks_rows_that_do_not_fit(spark, csv):
    rows = read_raw_csv(spark, csv).select("patient_id", S.MALFORMED).collect()
    assert len(rows) == len(LINES)
    assert {r["patient_id"] for r in rows if r[S.MALFORMED]} == {"P6", "P7", "P8"}


def test_wrong_width_is_refused(spark, folder):
    (folder / "narrow.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="expected 11 columns"):
        read_raw_csv(spark, str(folder / "narrow.csv"))


def test_csv_is_parsed_and_derived(spark, csv):
    got = by_id(
        read_visits(spark, csv).where("wait_time <> 15 OR wait_time IS NULL"),
        "admission_time", "hour", "time_of_day", "department_referral", "has_referral", "year", "week_number",
        "satisfaction_score_filled",
    )
    assert got["P1"] == ("08:05:09", 8, S.TIME_OF_DAY["morning"], "Cardio", True, 2020, 10, 7.0)
    assert got["P2"] == ("20:05:09", 20, S.TIME_OF_DAY["evening"], "None", False, 2020, 10, 9.0)
    assert got["P3"] == ("00:00:00", 0, S.TIME_OF_DAY["night"], "None", False, None, 0, 3.5)
    assert got["P4"][:3] == (None, None, S.TIME_OF_DAY["unknown"])


def test_unknown_source(spark, csv):
    with pytest.raises(ValueError, match="source must be"):
        read_visits(spark, csv, "orc")


def test_ingest_splits_good_and_bad_rows(spark, csv, folder):
    target = str(folder / "table")
    counts = {r["rule"]: r["violations"] for r in ingest(spark, csv, target).collect()}
    assert counts["record_well_formed"] == 3
    assert counts["admission_date_present"] == 2  # the bad date and the empty line
    assert counts["row_not_empty"] == 1
    assert counts["patient_id_unique"] == 1
    valid, bad = read_valid(spark, target), read_quarantine(spark, target)
    assert valid.columns == list(S.ALL_COLUMNS)
    assert sorted(r[0] for r in valid.select("patient_id").collect()) == ["P1", "P1", "P2", "P4", "P5"]
    assert bad.count() == 5
    assert by_id(bad, S.MALFORMED)["P8"][0].endswith("extra")
    assert "record_well_formed" in by_id(bad, quality.VIOLATIONS)["P6"][0]


def test_parquet_and_table_are_partitioned_by_month(spark, sf_dir, folder):
    table = visits(spark, sf_dir)
    target = str(folder / "visits")
    write_parquet(table, target)
    back = read_visits(spark, target, "parquet")
    assert back.count() == table.count()
    assert back.select(*table.columns).exceptAll(table).isEmpty()
    plan = back.where((F.col("year") == 1996) & (F.col("wait_time") > 50))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "GreaterThan(wait_time,50)" in plan
    save_table(table, "visit_table")
    assert spark.table("visit_table").count() == table.count()
    save_table(table.limit(5), "visit_table")
    assert spark.table("visit_table").count() == 5
    spark.sql("DROP TABLE visit_table")


def test_export_keeps_all_columns(spark, sf_dir, folder):
    table = visits(spark, sf_dir)
    export_csv(table, str(folder / "out"))
    back = spark.read.option("header", True).csv(str(folder / "out"))
    assert (back.columns, back.count()) == (table.columns, table.count())


def test_raw_file_round_trip(spark, sf_dir, folder):
    raw_text(spark, sf_dir).write.option("header", True).csv(str(folder / "raw"))
    loaded = read_visits(spark, str(folder / "raw"))
    expected = visits(spark, sf_dir)
    assert loaded.select(*expected.columns).exceptAll(expected).isEmpty()
    assert loaded.count() == expected.count()


def test_lookups_are_joined_only_when_needed(spark, sf_dir):
    def plan(*columns):
        return visits(spark, sf_dir, *columns)._jdf.queryExecution().executedPlan().toString()

    assert "customer" not in plan("wait_time", "hour", "age_group", "is_admitted")
    assert "customer" in plan("department_referral") and "region" not in plan("department_referral")
    assert "region" in plan("race")


def test_keep(spark, sf_dir):
    table = keep(visits(spark, sf_dir, "wait_time"))
    assert table.storageLevel.useMemory and table.storageLevel.useDisk
    table.unpersist()


FACTS = "/root/testdata/sf0.01"


def test_known_facts_at_one_hundredth(spark):
    v = visits(spark, FACTS)
    row = v.agg(
        F.count("*"), F.count_if(F.col("admission_date").isNull()), F.count_if(F.col("hour").isNull()),
        F.count_if(F.col("age_group").isNull()), F.count_if(F.col("wait_time").isNull()),
        F.count_if(F.col("wait_time") == 0), F.count("satisfaction_score"), F.count_if(F.col("is_admitted")),
        F.countDistinct("year"), F.count_if(F.col("satisfaction_score") <= 3),
    ).first()
    assert tuple(row) == (15000, 16, 169, 162, 72, 216, 4500, 7445, 7, 1295)


QUOTED = [
    ("Q1", '"O""Neil, Ann"', 'O"Neil, Ann'),
    ("Q2", '"a ""b"" c"', 'a "b" c'),
    ("Q3", '""', None),
    ("Q4", '"Lee, Bo"', "Lee, Bo"),
]


def test_quotes_are_those_of_spreadsheets(spark, folder):
    lines = [f"{i},03/07/2020,08:05:09 AM,{name},Female,30,R,Cardio,Admission,7,20" for i, name, _ in QUOTED]
    (folder / "quoted.csv").write_text("\n".join(['"Id, masked",' + HEADER.split(",", 1)[1], *lines]) + "\n")
    got = by_id(read_visits(spark, str(folder / "quoted.csv")), "patient_name", "wait_time")
    assert got == {i: (name, 20) for i, _, name in QUOTED}
    assert read_raw_csv(spark, str(folder / "quoted.csv")).where(F.col(S.MALFORMED).isNotNull()).isEmpty()


def test_line_breaks_in_quotes(spark, folder):
    line = '{},03/07/2020,08:05:09 AM,"Two\nlines, ""x""",Female,30,R,Cardio,Admission,7,20'
    (folder / "breaks.csv").write_text("\n".join([HEADER, line.format("B1"), line.format("B2")]) + "\n")
    got = by_id(read_visits(spark, str(folder / "breaks.csv"), multi_line=True), "patient_name", "wait_time")
    assert got == {i: ('Two\nlines, "x"', 20) for i in ("B1", "B2")}


def test_export_is_read_back_as_written(spark, folder):
    df = spark.createDataFrame([("a,b", 'say "x"', None), ("two\nlines", "", "z")], "a string, b string, c string")
    export_csv(df, str(folder / "out"))
    back = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(folder / "out"))
    assert sorted(r["a"] for r in back.collect()) == ["a,b", "two\nlines"]
    text = "".join(p.read_text() for p in (folder / "out").glob("part-*"))
    assert '"say ""x"""' in text and "\\" not in text


def test_every_file_needs_the_right_width(spark, folder):
    (folder / "many").mkdir()
    (folder / "many" / "a.csv").write_text("\n".join([HEADER, LINES[0]]) + "\n")
    (folder / "many" / "b.csv").write_text(f"{HEADER},More\n{LINES[0]},1\n")
    with pytest.raises(ValueError, match=r"header has 12: .*b\.csv"):
        read_raw_csv(spark, str(folder / "many"))


def test_ids_are_never_cut(spark, sf_dir, folder):
    from visitflow.operators import sampling

    for name in ("customer", "nation", "region"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(str(folder / f"{name}.parquet"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.withColumn("o_orderkey", F.col("o_orderkey") + 3_000_000_000).write.parquet(str(folder / "orders.parquet"))
    table, n = visits(spark, str(folder)), orders.count()
    assert table.select("patient_id").distinct().count() == n
    broken = {r["rule"]: r["violations"] for r in quality.summary(table).collect()}
    assert broken["patient_id_unique"] == 0
    assert sampling.with_test_flag(table.select("patient_id")).where("is_test").count() == -(-n // 5)
