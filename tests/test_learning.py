import tempfile

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from visitflow.operators import learning
from visitflow.plans.ml_report import ml_report
from visitflow.plans.report import statistical_report, write_sections
from visitflow.sources.star import visits

SMALL = {"trees": 10, "depth": 5}


def noise(seed):
    """A number in [0, 1) that depends on the id only."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.col("patient_id"))), 1, 6)
    return F.conv(digits, 16, 10).cast("double") / 16**6


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    df = visits(spark, sf_dir).persist()
    yield df
    df.unpersist()


def test_classifier_finds_the_planted_rule(table):
    long = F.coalesce(F.col("wait_time") > 30, F.lit(False))
    planted = table.withColumn("is_admitted", F.when(noise("c") < 0.05, ~long).otherwise(long))
    trained = learning.train_admission(planted, **SMALL)
    row = trained.metrics.first()
    assert row["accuracy"] > 0.85 and row["cv_f1_mean"] > 0.85 and row["cv_f1_std"] < 0.1
    features = trained.importances.collect()
    assert features[0]["feature"] == "wait_time"
    assert sorted(r["feature"] for r in features) == sorted(learning.FEATURES)
    assert sum(r["importance"] for r in features) == pytest.approx(1.0)
    again = learning.train_admission(planted, **SMALL, folds=0)
    assert again.metrics.first()["accuracy"] == row["accuracy"]
    target = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/model"
    learning.save_model(trained, target)
    assert len(PipelineModel.load(target + "/0").stages) == 2
    trained.release()
    again.release()


def test_one_class_is_refused(table):
    with pytest.raises(ValueError, match="both admitted"):
        learning.train_admission(table.where("is_admitted"), **SMALL)


def test_regressor_finds_the_planted_line(spark):
    table = visits(spark, "/root/testdata/sf0.01")  # the few very long waits need enough rows to be learned
    score = 10 - F.coalesce(F.col("wait_time"), F.lit(30)) / 10 + noise("r") * 0.2
    trained = learning.train_score(table.withColumn("satisfaction_score", score), trees=20, depth=8)
    row = trained.metrics.first()
    assert row["r2"] > 0.8 and row["n_training_samples"] == table.count()
    assert trained.importances.first()["feature"] == "wait_time"
    trained.release()


def test_segments_recover_planted_blobs(table):
    place = F.pmod(F.xxhash64("patient_id"), F.lit(4)).cast("int")
    blobs = table.select("patient_id").withColumn("blob", place).select(
        "patient_id", "blob",
        (F.when(F.col("blob") % 2 == 0, 10).otherwise(90) + noise("a")).cast("int").alias("age"),
        (F.when(F.col("blob") < 2, 10).otherwise(300) + noise("w")).cast("int").alias("wait_time"),
        F.lit(5.0).alias("satisfaction_score_filled"),
        F.lit(12).alias("hour"),
        (F.col("blob") < 2).alias("is_admitted"),
        F.lit(True).alias("has_referral"),  # constant, scaled to 0
    )
    result = learning.segment(blobs, starts=5)
    cells = result.clustered.groupBy("blob", "cluster").count().collect()
    assert len(cells) == 4
    assert result.profiles.agg(F.sum("size")).first()[0] == table.count()
    assert result.n_clusters == 4 and result.inertia < table.count() * 0.01
    assert result.clustered.columns == [*blobs.columns, "cluster"]
    assert learning.cluster_table(result.profiles).columns[1:3] == ["avg_age", "avg_wait"]


def test_drawn_segments_iterate_over_blocks(table):
    """Row by row, every iteration of every start would decode all points again."""
    result = learning.segment(table.select("patient_id", *learning.SEGMENT_FEATURES), starts=1)
    assert result.model.getSolver() == "block"
    assert result.profiles.agg(F.sum("size")).first()[0] == table.count()


def test_a_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, None)], "a double, b double")
    rows = [tuple(r) for r in learning.standardize(df, ["a", "b"]).collect()]
    assert rows == [(-1.0, 0.0), (1.0, 0.0), (None, None)]


def test_missing_labels_get_a_code_of_their_own(spark, table):
    codes = {(r["feature"], r["label"]): r["code"] for r in learning.label_codes(table).collect()}
    days = sorted(label for feature, label in codes if feature == "day_of_week")
    assert days[-1] == "nan" and codes[("day_of_week", "nan")] == len(days) - 1
    matrix, _ = learning.feature_matrix(table, "patient_id")
    assert matrix.columns == ["patient_id", *learning.FEATURES]
    assert matrix.where(" OR ".join(f"{c} IS NULL" for c in learning.FEATURES)).isEmpty()


def test_classification_metrics(spark):
    predictions = spark.createDataFrame(
        [(1, 1.0)] * 3 + [(0, 1.0)] + [(1, 0.0)] * 2 + [(0, 0.0)] * 4, "label int, prediction double"
    )
    report = {r["class"]: r for r in learning.classification_report(predictions).collect()}
    assert (report["1"]["precision"], report["1"]["recall"], report["1"]["support"]) == (0.75, 0.6, 5)
    assert report["1"]["f1"] == pytest.approx(2 / 3)
    assert report["0"]["precision"] == pytest.approx(2 / 3) and report["0"]["recall"] == 0.8
    assert report["0"]["f1"] == pytest.approx(0.7273, abs=1e-4)
    assert report["accuracy"]["f1"] == 0.7 and report["macro avg"]["recall"] == pytest.approx(0.7)
    assert report["weighted avg"]["support"] == 10
    assert learning.accuracy(predictions).first()[0] == 0.7
    assert [tuple(r) for r in learning.confusion(predictions).collect()] == [(0, 4, 1), (1, 2, 3)]
    table = learning.class_table(learning.classification_report(predictions)).collect()
    assert {r["class"]: r["f1"] for r in table} == {"Not Admitted": 0.7273, "Admitted": 0.6667}


def test_undefined_ratios_are_zero(spark):
    predictions = spark.createDataFrame([(0, 0.0)] * 3, "label int, prediction double")
    report = {r["class"]: r for r in learning.classification_report(predictions).collect()}
    assert tuple(report["1"])[1:] == (0.0, 0.0, 0.0, 0)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "label double, prediction double")
    row = learning.regression_metrics(df).first()
    assert row["mae"] == pytest.approx(1 / 3) and row["r2"] == pytest.approx(0.5)


def test_reports_are_written(spark, table):
    target = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sections = statistical_report(table)
    write_sections(sections, target + "/statistics")
    for name, frame in sections.items():
        assert spark.read.parquet(f"{target}/statistics/{name}").columns == frame.columns
    models, trained = ml_report(table, trees=5, depth=3, folds=2)
    write_sections({k: models[k] for k in ("admission_metrics", "segments")}, target + "/models", "csv")
    assert spark.read.option("header", True).csv(target + "/models/segments").count() == 4
    assert models["admission_top_features"].count() == 3
    assert models["segment_scatter"].count() == min(2000, table.count())
    for model in trained:
        model.release()


def test_the_layout_of_the_input_does_not_change_a_model(table):
    known = table.select("patient_id", "is_admitted", *learning.FEATURES).limit(600).persist()
    seen = []
    for n in (1, 4, 16, 64):
        trained = learning.train_admission(known.repartition(n), trees=4, depth=6, folds=0)
        seen.append((trained.metrics.first()["accuracy"], [tuple(r) for r in trained.importances.collect()]))
        trained.release()
    assert all(x == seen[0] for x in seen)
    known.unpersist()


def test_no_more_visits_are_learned_from_than_allowed(table):
    trained = learning.train_admission(table, trees=2, depth=3, folds=0, labelled=100)
    assert trained.data.where("is_fit").count() == 100
    assert trained.predictions.count() == trained.data.where("is_test").count()
    trained.release()


def test_nearest_takes_the_first_of_equals(spark):
    points = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (1.0, 0.0)], "x double, y double")
    got = learning.nearest(points, [(0, 0), (2, 0)], ["x", "y"])
    assert sorted((r["x"], r["cluster"], r["distance"]) for r in got.collect()) == [
        (0.0, 0, 0.0), (1.0, 0, 1.0), (2.0, 1, 0.0)]
    assert tuple(learning.inertia(got).first()) == (1.0, 3)


def test_visits_learned_from_are_counted_apart(table):
    trained = learning.train_score(table, trees=2, depth=2, labelled=40)
    row = trained.metrics.first()
    assert row["n_training_samples"] == table.where("satisfaction_score IS NOT NULL").count()
    assert row["n_fit_samples"] == trained.data.where("is_fit AND NOT is_test").count()
    assert 0 < row["n_fit_samples"] <= 40
    trained.release()


def test_every_call_of_a_query_trains(spark, sf_dir, monkeypatch):
    from __spark_entry__ import queries

    calls, train = [], learning.train_score
    monkeypatch.setattr(learning, "train_score", lambda df: calls.append(1) or train(df, trees=2, depth=2))
    first, again = (queries()["score_model_metrics"](spark, sf_dir).collect() for _ in range(2))
    assert len(calls) == 2 and first == again
