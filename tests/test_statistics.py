import math
import statistics

import pytest
from pyspark.sql import functions as F

from visitflow.functions.student import two_sided_p
from visitflow.operators import charts, learning, membership, quantiles, sampling, stats
from visitflow.sources import schema as S
from visitflow.sources.star import visits


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# --- p-values -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(
    ("t", "df", "p"),
    # Quantiles from printed tables of the t distribution.
    [(12.706, 1, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05), (0.0, 7, 1.0)],
)
def test_p_values_from_tables(t, df, p):
    assert two_sided_p(t, df) == pytest.approx(p, abs=2e-4)


def test_p_value_limits():
    assert two_sided_p(1.959964, 5e6) == pytest.approx(0.05, abs=1e-6)
    assert two_sided_p(1.959964, 1e12) == pytest.approx(0.05, abs=1e-6)
    assert two_sided_p(-2.0, 20) == two_sided_p(2.0, 20)
    assert two_sided_p(200.0, 1e4) == pytest.approx(0.0, abs=1e-12)
    assert two_sided_p(None, 5) is None and two_sided_p(1.0, 0) is None and two_sided_p(math.nan, 4) is None
    one = [two_sided_p(1.5, 1), 1 - 2 / math.pi * math.atan(1.5)]  # closed form for one degree of freedom
    assert one[0] == pytest.approx(one[1], rel=1e-12)


# --- tests and correlation ----------------------------------------------------------------------------------------

def waits(spark, admitted, other):
    rows = [(True, x) for x in admitted] + [(False, x) for x in other]
    return frame(spark, rows, "is_admitted boolean, wait_time int")


def test_t_test(spark):
    row = stats.wait_t_test(waits(spark, [1, 2, 3], [2, 4, 6])).first()
    assert tuple(row) == (-1.5492, 4, 0.1963, "not significant")


@pytest.mark.parametrize("other", [[], [None]])
def test_t_test_with_an_empty_side(spark, other):
    row = stats.wait_t_test(waits(spark, [1, 2, 3], other)).first()
    assert (row["t_stat"], row["p_value"], row["verdict"]) == (None, None, None)


def test_correlation_uses_complete_pairs(spark):
    df = frame(spark, [(1.0, 2), (2.0, 1), (3.0, 4), (4.0, 3), (5.0, None)], "satisfaction_score double, wait_time int")
    assert tuple(stats.score_wait_correlation(df).first()) == (4, 0.6, 0.4, "not significant")


def test_perfect_correlation(spark):
    df = frame(spark, [(1.0, 1), (2.0, 2), (3.0, 3)], "satisfaction_score double, wait_time int")
    row = stats.score_wait_correlation(df).first()
    assert (row["pearson_r"], row["p_value"]) == (1.0, 0.0)


def test_known_statistics_at_one_hundredth(spark):
    v = visits(spark, "/root/testdata/sf0.01")
    t = stats.wait_t_test(v).first()
    assert (t["t_stat"], t["p_value"]) == (1.3834, 0.1666)
    assert stats.score_wait_correlation(v).first()["pearson_r"] == -0.4607
    s = stats.anomaly_summary(v).first()
    assert (s["lower_bound"], s["upper_bound"], s["n_anomalies"]) == (-33.0, 95.0, 154)


# --- quantiles and anomalies --------------------------------------------------------------------------------------

def test_summary_against_brute_force(spark, sf_dir):
    v = visits(spark, sf_dir, "wait_time")
    data = [r[0] for r in v.collect() if r[0] is not None]
    row = stats.wait_summary(v).first()
    low, mid, high = statistics.quantiles(data, n=4, method="inclusive")
    assert (row["p25"], row["median"], row["p75"]) == (low, mid, high)
    assert row["mean"] == pytest.approx(statistics.fmean(data))
    assert row["std"] == pytest.approx(statistics.stdev(data))
    assert (row["min"], row["max"]) == (min(data), max(data))


def test_medians_in_one_pass(spark):
    df = frame(spark, [(1, 10.0, None), (2, None, None), (3, 30.0, None), (4, 20.0, None)], "a int, b double, c int")
    got = spark.range(1).select(quantiles.medians(df, ["a", "b", "c"]).alias("m")).first()["m"]
    assert got == {"a": 2.5, "b": 20.0, "c": None} or got == {"a": 2.5, "b": 20.0}


def test_moments_and_sketch(spark):
    df = frame(spark, [(x,) for x in (1, 1, 2, 5)], "x int")
    row = quantiles.weighted_moments(quantiles.value_counts(df, "x"), "x").first()
    assert (row["count"], row["mean"]) == (4, 2.25) and row["std"] == pytest.approx(statistics.stdev([1, 1, 2, 5]))
    assert quantiles.sketched(df, "x", [0.0, 1.0], 0.01).first()["q"] == [1.0, 5.0]
    assert quantiles.sketched(df.where("x > 9"), "x", [0.5], 0.01).collect()[0]["q"] is None


N = 1_000_000


@pytest.fixture(scope="module")
def continuous(spark):
    """A million different waits, in an order of their own, over several partitions; every tenth row has none."""
    wait = F.pmod(F.col("id") * 7919, F.lit(N)) / 100.0
    df = spark.range(0, N, 1, 12).select(
        F.when(F.col("id") % 10 != 0, wait).alias("wait_time"),
        F.when(F.col("id") % 3 == 0, "Monday").otherwise("Tuesday").alias("day_of_week"),
    ).persist()
    yield df
    df.unpersist()


def _rank(df, value):
    return df.where(F.col("wait_time") <= value).count() / df.where("wait_time IS NOT NULL").count()


@pytest.mark.parametrize("accuracy", [0.01, 0.001])
def test_sketched_quartiles_keep_their_rank_error(continuous, accuracy):
    row = stats.wait_summary(continuous, accuracy).first()
    for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
        assert abs(_rank(continuous, row[name]) - p) <= accuracy
    exact = continuous.agg(F.avg("wait_time"), F.stddev_samp("wait_time"), F.min("wait_time"), F.max("wait_time")).first()
    assert (row["mean"], row["std"], row["min"], row["max"]) == tuple(exact)
    bounds = stats.wait_bounds(continuous, accuracy).first()
    assert abs(_rank(continuous, bounds["q1"]) - 0.25) <= accuracy
    assert bounds["upper_bound"] == bounds["q3"] + 1.5 * (bounds["q3"] - bounds["q1"])
    assert stats.anomaly_summary(continuous, accuracy).first()["n_anomalies"] == stats.anomalies(continuous, accuracy).count()


def test_sketched_boxes_and_medians(continuous):
    accuracy = 0.005
    boxes = {r["day_of_week"]: r for r in charts.box(
        continuous, "wait_time", "day_of_week", ["Monday", "Tuesday"], accuracy).collect()}
    assert list(boxes) == ["Monday", "Tuesday"]
    for day, row in boxes.items():
        own = continuous.where(F.col("day_of_week") == day)
        assert abs(_rank(own, row["median"]) - 0.5) <= accuracy and row["outliers"] == 0
        assert row["high_whisker"] == own.agg(F.max("wait_time")).first()[0]
    middle = learning.fit_medians(continuous, ["wait_time"], accuracy)["wait_time"]
    assert abs(_rank(continuous, middle) - 0.5) <= accuracy
    filled = learning.impute(continuous, ["wait_time"], accuracy).groupBy("wait_time").count().orderBy(F.desc("count"))
    most = filled.first()
    assert most["count"] > N / 10 and abs(_rank(continuous, most["wait_time"]) - 0.5) <= accuracy


def test_a_sketch_has_the_size_of_its_error_not_of_its_rows(continuous):
    sizes = [
        df.agg(F.length(F.kll_sketch_agg_double("wait_time", quantiles.sketch_size(0.01)))).first()[0]
        for df in (continuous.where("wait_time < 1000"), continuous)
    ]
    assert sizes[1] < 2 * sizes[0] < 40_000
    assert quantiles.sketch_size(0.001) > quantiles.sketch_size(0.01) > quantiles.sketch_size(0.1) >= 8


def test_anomalies(spark):
    values = [0, 50, 51, 52, 53, 54, 200]
    df = frame(spark, [(str(i), w) for i, w in enumerate(values)], "patient_id string, wait_time int")
    assert tuple(stats.wait_bounds(df).first()) == (50.5, 53.5, 46.0, 58.0)
    assert set(pairs(stats.anomalies(df), "wait_time", "anomaly_type")) == {
        (0, "Unusually Low Wait"), (200, "High Wait"),
    }
    normal = {r["wait_time"] for r in df.collect()} - {0, 200}
    scatter = dict(pairs(stats.anomaly_scatter(df.withColumn("admission_date", F.current_date())),
                         "wait_time", "status"))
    assert {w for w, s in scatter.items() if s == "Normal"} == normal


def test_marks_go_by_id(spark):
    rows = [("A", 10), ("A", 900), ("B", 10), ("C", 11), ("D", 12), ("E", 11), ("F", 10), (None, 10)]
    df = frame(spark, rows, "patient_id string, wait_time int").withColumn("admission_date", F.current_date())
    assert stats.anomalies(df).count() == 1
    marked = pairs(stats.anomaly_scatter(df).where("status = 'Anomaly'"), "patient_id", "wait_time")
    assert sorted(marked) == [("A", 10), ("A", 900)]
    assert stats.visits_of_anomalous_ids(df).count() == 2


def test_no_waits_no_anomalies(spark):
    df = frame(spark, [("A", None)], "patient_id string, wait_time int")
    row = stats.anomaly_summary(df).first()
    assert (row["lower_bound"], row["n_anomalies"], row["pct_anomalies"]) == (None, 0, 0.0)


def test_profile(spark):
    df = frame(spark, [("a", None), ("b", 1), (None, 2)], "s string, n int")
    assert sorted(pairs(stats.profile(df), "column", "type", "missing", "missing_pct", "n_rows", "n_columns")) == [
        ("n", "int", 1, 33.33, 3, 2), ("s", "string", 1, 33.33, 3, 2),
    ]


# --- membership ---------------------------------------------------------------------------------------------------

def test_membership_with_a_hot_key(spark):
    # A third of the rows share one key and are otherwise identical, too.
    hot = spark.range(300).select(F.lit("hot").alias("k"), F.lit(1).alias("x"))
    rest = spark.range(600).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.lit(1).alias("x"))
    df = hot.unionByName(rest).repartition(7)
    keys = frame(spark, [("hot",), ("hot",), ("k5",), ("absent",), (None,)], "k string")
    marked = membership.mark_members(df, keys, "k", "hit")
    assert marked.columns == ["k", "x", "hit"] and marked.count() == 900
    assert marked.where("hit").count() == 301
    assert membership.members_only(df, keys, "k").count() == 301


# --- samples, splits, folds ---------------------------------------------------------------------------------------

def keyed(spark, n):
    return spark.range(n).select(F.concat(F.lit("p"), F.col("id")).alias("patient_id"), (F.col("id") % 3 == 0).alias("y"))


def ranked(df):
    rows = df.withColumn("h", sampling.hash_key(42)).collect()
    return sorted((r["h"], r["patient_id"], r["y"]) for r in rows)


@pytest.mark.parametrize("n", [1, 7, 999])
def test_split_against_brute_force(spark, n):
    df = keyed(spark, n)
    test = {p for y in (True, False) for _, p, _ in _first_fifth([r for r in ranked(df) if r[2] == y])}
    got = sampling.with_test_flag(df, label="y")
    assert {r["patient_id"] for r in got.where("is_test").collect()} == test
    assert got.count() == n
    train, held = sampling.split(df, label="y")
    assert train.count() + held.count() == n and held.count() == len(test)


def _first_fifth(rows):
    return rows[: math.ceil(round(0.2 * len(rows), 6))]


def test_folds_are_even_within_each_label(spark):
    df = sampling.with_fold(keyed(spark, 1000), "y")
    sizes = {(r["y"], r["fold"]): r["count"] for r in df.groupBy("y", "fold").count().collect()}
    assert len(sizes) == 10
    assert {n for (y, _), n in sizes.items() if y} <= {66, 67} and sum(sizes.values()) == 1000


def test_sample_is_exact_and_reproducible(spark):
    df = keyed(spark, 5000)
    expected = [p for _, p, _ in ranked(df)[:100]]
    assert [r["patient_id"] for r in sampling.sample_exact(df, 100).collect()] == expected
    assert [r["patient_id"] for r in sampling.sample_exact(df.repartition(9), 100).collect()] == expected
    assert sampling.sample_exact(keyed(spark, 5), 100).count() == 5
    assert sampling.sample_exact(keyed(spark, 0), 100).count() == 0


def test_copies_of_an_id_stay_together(spark):
    df = keyed(spark, 200).unionByName(spark.range(100).select(F.lit("p7").alias("patient_id"), F.lit(False).alias("y")))
    got = sampling.with_test_flag(df, label="y")
    assert got.count() == 300
    assert got.where("patient_id = 'p7'").select("is_test").distinct().count() == 1
    assert sampling.sample_exact(df, 250).count() == 250


# --- charts -------------------------------------------------------------------------------------------------------

def test_histogram_covers_everything(spark, sf_dir):
    v = visits(spark, sf_dir)
    bins = charts.age_histogram(v).collect()
    assert sum(r["count"] for r in bins) == v.where("age IS NOT NULL").count() and len(bins) <= 30
    assert len(charts.score_histogram(v).collect()) <= 11


def test_box(spark):
    rows = [("Monday", w) for w in (0, 50, 51, 52, 53, 54, 200)] + [("Friday", 5), ("x", 1), (None, 2)]
    df = frame(spark, rows, "day_of_week string, wait_time int")
    got = charts.wait_box_by_weekday(df).collect()
    assert [r["day_of_week"] for r in got] == ["Monday", "Friday"]
    monday = got[0].asDict()
    assert (monday["low_whisker"], monday["high_whisker"], monday["outliers"], monday["count"]) == (50, 54, 2, 7)
    assert pairs(charts.wait_outliers_by_weekday(df), "day_of_week", "wait_time", "count") == [
        ("Monday", 0, 1), ("Monday", 200, 1),
    ]


def test_heatmap_has_all_days_and_hours(spark):
    df = frame(spark, [("Monday", 3, 10), ("Monday", 3, 20), (None, 1, 5)], "day_of_week string, hour int, wait_time int")
    rows = charts.wait_heatmap(df).collect()
    assert [r["day_of_week"] for r in rows] == list(S.WEEKDAYS)
    assert rows[0]["h03"] == 15.0 and rows[1]["h03"] is None and len(rows[0]) == 25


def test_density_integrates_to_one(spark):
    import random

    rng = random.Random(1)
    rows = [("Teen (13-17)", round(min(10, max(0, rng.gauss(5, 1))), 1)) for _ in range(400)]
    rows += [("Child (0-12)", 4.0)]  # a single score has no density
    df = frame(spark, rows, "age_group string, satisfaction_score double")
    got = charts.score_density_by_age_group(df).collect()
    teen = [r for r in got if r["age_group"].startswith("Teen")]
    step = teen[1]["satisfaction_score"] - teen[0]["satisfaction_score"]
    assert sum(r["density"] for r in teen) * step == pytest.approx(1.0, abs=0.05)
    assert {r["density"] for r in got if r["age_group"].startswith("Child")} == {None}


def test_trend_line(spark):
    df = frame(spark, [(0, 10.0), (10, 9.0), (20, 8.0), (5, None)], "wait_time int, satisfaction_score double")
    line = stats.trend_line(df).orderBy("point").collect()
    assert len(line) == 100
    assert (line[0]["wait_time"], line[-1]["wait_time"]) == (0.0, 20.0)
    assert line[-1]["score"] == pytest.approx(8.0)


def test_quick_chart(spark):
    df = frame(spark, [(i, f"n{i}", 2.0) for i in range(30)], "a int, b string, c double")
    chart = charts.quick_chart(df)
    assert chart.columns == ["b", "a"] and chart.count() == 20
    assert charts.quick_chart(df.limit(1)) is None
    assert charts.quick_chart(df.select("a")) is None
