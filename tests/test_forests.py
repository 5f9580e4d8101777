"""Forests in groves against forests fitted one by one, and K-Means from fixed starts against plain Lloyd steps."""

from statistics import fmean, pstdev

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from visitflow.operators import forests, learning, lloyd
from visitflow.sources.star import visits


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    columns = ("patient_id", *learning.FEATURES, "is_admitted", "satisfaction_score", "satisfaction_score_filled",
               "has_referral")
    df = visits(spark, sf_dir, *columns).persist()
    yield df
    df.unpersist()


def _by_hand(trained, label_rows, learn, predict, trees, grove, seed=42, depth=4):
    """Votes of groves fitted on their own, as predictions by row."""
    votes = {}
    for g, low in enumerate(range(0, trees, grove)):
        forest = RandomForestClassifier(
            numTrees=min(grove, trees - low), seed=seed + g, **learning._forest_options(trained.encoder, depth))
        model = forest.fit(forests.fitted_rows(learn))
        for r in model.transform(predict).select("patient_id", "rawPrediction").collect():
            before = votes.get(r["patient_id"], (0.0, 0.0))
            votes[r["patient_id"]] = tuple(a + float(b) for a, b in zip(before, r["rawPrediction"], strict=True))
    return {i: float(max(range(2), key=lambda c: (v[c], -c))) for i, v in votes.items()}


def _f1(pairs):
    hit = sum(a == b == 1 for a, b in pairs)
    return 2 * hit / (sum(a for a, _ in pairs) + sum(b for _, b in pairs))


def test_folds_equal_separate_fits(table):
    """Mean and deviation of F1 from one count, against a separate fit and count for each fold."""
    trained = learning.train_admission(table, trees=5, depth=4, folds=3, grove=2)
    data, scores = trained.data, []
    for fold in range(3):
        learn = learning._learned(data, f"fold <> {fold}")
        held_out = data.where(F.col("fold") == fold)
        said = _by_hand(trained, data, learn, held_out, 5, 2)
        label = {r["patient_id"]: r["label"] for r in held_out.collect()}
        assert {r["patient_id"]: r["prediction"] for r in trained.out_of_fold.where(
            F.col("fold") == fold).collect()} == said
        scores.append(_f1([(label[i], said[i]) for i in label]))
    row = trained.metrics.first()
    assert row["cv_f1_mean"] == pytest.approx(fmean(scores), abs=1e-12)
    assert row["cv_f1_std"] == pytest.approx(pstdev(scores), abs=1e-12)
    assert trained.out_of_fold.count() == data.count()


def test_votes_of_up_to_ten_groves_are_not_shuffled(table):
    trained = learning.train_admission(table, trees=4, depth=3, folds=0, grove=2)
    task = forests.Task(learning._learned(trained.data, "NOT is_test"), trained.data.select(forests.ROW, "label", "features"))
    estimator = RandomForestClassifier(**learning._forest_options(trained.encoder, 3))
    _, votes = forests.grown(estimator, [task], 10, 42, 1)
    assert "Exchange" not in votes._jdf.queryExecution().executedPlan().toString()
    assert votes.columns == [forests.ROW, "label", "votes", "forest"]
    assert votes.count() == trained.data.count() == votes.select(forests.ROW).distinct().count()


def test_more_groves_than_vote_together(table):
    trained = learning.train_admission(table, trees=12, depth=3, folds=0, grove=1)
    said = _by_hand(trained, None, learning._learned(trained.data, "NOT is_test"), trained.data.where("is_test"), 12, 1, depth=3)
    assert {r["patient_id"]: r["prediction"] for r in trained.predictions.collect()} == said
    assert len(trained.model.groves) == 12 and sum(trained.model.trees) == 12


def test_groves_side_by_side_or_one_at_a_time(table):
    rated = table.where("satisfaction_score IS NOT NULL")
    found = []
    for parallelism in (1, 10):
        trained = learning.train_score(rated, trees=10, depth=6, grove=1, parallelism=parallelism)
        found.append((sorted(tuple(r) for r in trained.predictions.collect()), trained.model.nodes,
                      [tuple(r) for r in trained.importances.collect()]))
        assert len(trained.model.groves) == 10 and len(list(trained.model.models())) == 10
    assert found[0] == found[1]


def test_a_forest_of_one_grove_is_a_plain_forest(table):
    trained = learning.train_score(table, trees=6, depth=5)
    options = learning._forest_options(trained.encoder, 5)
    plain = RandomForestRegressor(numTrees=6, seed=42, featureSubsetStrategy="all", **options).fit(
        forests.fitted_rows(learning._learned(trained.data, "NOT is_test")))
    want = plain.transform(trained.data.where("is_test")).select("patient_id", "prediction").collect()
    have = {r["patient_id"]: r["prediction"] for r in trained.predictions.collect()}
    assert {r["patient_id"]: pytest.approx(r["prediction"], abs=1e-9) for r in want} == have
    assert trained.model.featureImportances == pytest.approx(plain.featureImportances.toArray())


def test_empty_f1_is_zero(spark):
    rows = [(0, 0, 0.0), (0, 0, 0.0), (1, 1, 1.0), (1, 1, 0.0), (1, 0, 1.0)]
    scores = learning.fold_scores(spark.createDataFrame(rows, "fold int, label int, prediction double"))
    assert {r["fold"]: r["f1"] for r in scores.collect()} == {0: 0.0, 1: 0.5}


def _plain_lloyd(points, centres, shift):
    """Whole-number Lloyd steps over all rows."""
    while True:
        own = {}
        for p in points:
            near = min(range(len(centres)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(p, centres[i], strict=True)), i))
            own.setdefault(near, []).append(p)
        after = [
            tuple((2 * sum(x) + len(own[i])) // (2 * len(own[i])) for x in zip(*own[i], strict=True)) if i in own else c
            for i, c in enumerate(centres)
        ]
        moved = sum((a - b) ** 2 for x, y in zip(centres, after, strict=True) for a, b in zip(x, y, strict=True))
        centres = after
        if moved < shift * lloyd.UNIT**2:
            return centres, sum(min(sum((a - b) ** 2 for a, b in zip(p, c, strict=True)) for c in centres) for p in points)


def test_lloyd_steps_against_all_rows(spark):
    rows = [(f"P{i:03d}", (i * 37 % 11) * 300_000, (i * i) % 7 * 450_000) for i in range(120)] + [("P003", 5, 5)] * 3
    points = spark.createDataFrame(rows, "patient_id string, x bigint, y bigint")
    found = lloyd.fit(points, ["x", "y"], 3, 4, 42, 1e-4)
    best = []
    for s, start in enumerate(lloyd.first_centres(points, ["x", "y"], 3, 4, 42)):
        centres, cost = _plain_lloyd([r[1:] for r in rows], start, 1e-4)
        best.append((cost, s, centres))
    assert (found.inertia, found.start, found.centres) == min(best)
    again = lloyd.fit(points.repartition(7), ["x", "y"], 3, 4, 42, 1e-4)
    assert again == found


def test_sums_of_a_round_are_exact(spark):
    """Values whose sums are beyond the whole numbers of doubles, over more than one slice, and ties to the first centre."""
    rows = [(i % 7 * 10**14 + i, 5 - i % 3 * 10**14, 1 + i % 5) for i in range(20_000)] + [(-10**15, 0, 1000)] * 3
    centres = [[(0, 0), (5 * 10**14, 0), (0, 0)], [(-10**15, 0), (10**15, 7), (3, 3)]]
    points = spark.createDataFrame(rows, "x bigint, y bigint, n bigint").repartition(3)
    found = points.mapInArrow(
        lloyd._sums(["x", "y"], centres), "s int, cluster int, n bigint, x decimal(38,0), y decimal(38,0)")
    have = {(r["s"], r["cluster"]): (int(r["n"]), int(r["x"]), int(r["y"]))
            for r in found.groupBy("s", "cluster").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
    want = {}
    for x, y, n in rows:
        for s, own in enumerate(centres):
            far = [(float(x) - a) ** 2 + (float(y) - b) ** 2 for a, b in own]
            key = (s, far.index(min(far)))
            want[key] = tuple(t + v for t, v in zip(want.get(key, (0, 0, 0)), (n, x * n, y * n), strict=True))
    assert have == want and (0, 2) not in have


def test_clusters_are_assigned_by_compiled_code(spark):
    points = spark.createDataFrame([("a", -3, 0), ("b", 4, 0), ("c", 1, 0)], "patient_id string, x bigint, y bigint")
    got = lloyd.assign(points, ["x", "y"], [(-2, 0), (4, 0)])
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r)[::3] for r in got.collect()) == [("a", 0), ("b", 1), ("c", 0)]


def test_few_or_no_rows(spark):
    schema = "patient_id string, x bigint, y bigint"
    two = spark.createDataFrame([("a", 1, 2), ("b", 900_000, 2)], schema)
    found = lloyd.fit(two, ["x", "y"], 4, 10, 42, 1e-4)
    assert found.inertia == 0 and sorted(found.centres) == [(1, 2), (900_000, 2)]
    none = spark.createDataFrame([], schema)
    empty = lloyd.fit(none, ["x", "y"], 4, 10, 42, 1e-4)
    assert empty.centres == [] and lloyd.assign(none, ["x", "y"], empty.centres).columns == [*none.columns, "cluster"]


def test_fixed_starts_find_planted_blobs(table):
    place = F.pmod(F.xxhash64("patient_id"), F.lit(4)).cast("int")
    blobs = table.select("patient_id").withColumn("blob", place).select(
        "patient_id", "blob", F.when(F.col("blob") % 2 == 0, 10).otherwise(90).alias("age"),
        F.when(F.col("blob") < 2, 10).otherwise(300).alias("wait_time"), F.lit(5.0).alias("satisfaction_score_filled"),
        F.lit(12).alias("hour"), (F.col("blob") < 2).alias("is_admitted"), F.lit(True).alias("has_referral"))
    result = learning.segment_from_fixed_starts(blobs)
    assert result.fit.inertia == 0
    assert result.clustered.groupBy("blob", "cluster").count().count() == 4
    assert result.clustered.columns == [*blobs.columns, "cluster"]
