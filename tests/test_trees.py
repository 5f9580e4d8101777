"""Trees grown whole, against every possible split, against MLlib's walk through the same trees, and on all rows."""

import tempfile
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from visitflow.operators import learning, trees

ARITY = [4, 0, 70, 0]


def _points(n, seed=0):
    rng = np.random.default_rng(seed)
    codes = [rng.integers(0, k, n).astype(np.uint8) for k in (4, 30, 6, 5)]
    codes[2] *= 11  # categories beyond the 64 of one word
    values = [np.arange(4.0), np.sort(rng.normal(size=30)), np.arange(70.0), np.array([0.0, 0.5, 2.0, 3.0, 900.0])]
    return codes, values, (rng.random(n) < 0.4).astype(np.uint8), rng.poisson(1.0, n).astype(np.uint8)


def _impurity(weights, label):
    total, one = int(weights.sum()), int((weights * label).sum())
    return 2 * one * (total - one) / total if total else 0.0


def _sides(value, nominal):
    """The left side of every possible split."""
    seen = sorted(set(value.tolist()))
    if nominal:
        return [np.isin(value, s) for k in range(1, len(seen)) for s in combinations(seen, k)]
    return [value <= t for t in seen[:-1]]


@pytest.mark.parametrize("batch", [16, 262_144])
def test_every_split_is_the_best_of_all(monkeypatch, batch):
    monkeypatch.setattr(trees, "BATCH", batch)
    codes, values, label, weights = _points(250)
    rows = np.arange(250, dtype=np.int32)
    tree = trees.grow(np.stack(codes, axis=1), values, ARITY, label, rows, weights, np.random.default_rng(1), 30, 4)
    of, gains = {0: np.flatnonzero(weights)}, np.zeros(4)
    leaf = trees.leaves(tree, ARITY, np.stack(codes, axis=1))
    for i, j in enumerate(tree.feature):
        own = of[i]
        w, y = weights[own].astype(int), label[own].astype(int)
        assert (w.sum(), (w * y).sum()) == (tree.total[i], tree.ones[i])
        losses = [_impurity(w[s], y[s]) + _impurity(w[~s], y[~s])
                  for f in range(4) for s in _sides(codes[f][own], ARITY[f])]
        best = _impurity(w, y) - min(losses, default=_impurity(w, y))
        if j < 0:
            assert best == pytest.approx(0, abs=1e-9) and set(own) <= set(np.flatnonzero(leaf == i))
            continue
        v, cut = codes[j][own], tree.code[i]
        left = (tree.masks[cut][v >> 6] >> (v & 63).astype(np.uint64)) & np.uint64(1) > 0 if ARITY[j] else v <= cut
        found = _impurity(w, y) - _impurity(w[left], y[left]) - _impurity(w[~left], y[~left])
        assert found == pytest.approx(best) and best > 0
        gains[j] += found
        of[tree.left[i]], of[tree.left[i] + 1] = own[left], own[~left]
    assert tree.importance == pytest.approx(gains)


def test_depth_and_one_class():
    codes, values, label, weights = _points(500, 1)
    rows, rng = np.arange(500, dtype=np.int32), np.random.default_rng(2)
    assert len(trees.grow(np.stack(codes, axis=1), values, ARITY, label, rows, weights, rng, 1, 2).feature) == 3
    assert len(trees.grow(np.stack(codes, axis=1), values, ARITY, np.ones_like(label), rows, weights, rng, 30, 2).feature) == 1
    assert len(trees.grow(np.stack(codes, axis=1), values, ARITY, label, rows, weights, rng, 0, 2).feature) == 1


def _visits(spark, n):
    """Admitted are visits of a long or unknown wait, but for a twentieth."""
    i = F.col("id")
    return spark.range(n).select(
        F.format_string("P%07d", i).alias("patient_id"),
        *[F.element_at(F.array(*map(F.lit, "abcd")), F.pmod(F.xxhash64(i, F.lit(c)), F.lit(4)).cast("int") + 1).alias(c)
          for c in learning.CATEGORIES],
        F.pmod(F.xxhash64(i, F.lit("age")), F.lit(100)).cast("int").alias("age"),
        F.pmod(F.xxhash64(i, F.lit("hour")), F.lit(24)).cast("int").alias("hour"),
        F.when(i % 50 > 0, F.pmod(F.xxhash64(i, F.lit("wait")), F.lit(60))).cast("int").alias("wait_time"),
    ).withColumn("is_admitted", (F.coalesce("wait_time", F.lit(60)) > 30) != (F.pmod(F.xxhash64("patient_id"), F.lit(20)) == 0))


def test_all_visits_are_learned_from(spark):
    visits = _visits(spark, 14_000).persist()
    trained = learning.train_admission(visits, trees=10, folds=2, grove=5)
    assert trained.data.where("is_fit").count() == 14_000
    row = trained.metrics.first()
    assert row["accuracy"] > 0.85 and row["cv_f1_mean"] > 0.85
    assert trained.out_of_fold.count() == 14_000
    assert trained.predictions.count() == trained.data.where("is_test").count() >= 2_800
    assert trained.model.trees == [5, 5] and trained.importances.first()["feature"] == "wait_time"
    kept = spark.read.parquet(trained.model.folder).where(" OR ".join(f"({g})" for g in trained.model.groves)).collect()
    drawn = [pa.ipc.open_stream(r["packed"]).read_all()["total"][0].as_py() for r in kept]
    assert len(drawn) == 10 and all(abs(n - 11_200) < 600 for n in drawn)  # 80 %, drawn with repetition
    visits.unpersist()


def test_saved_trees_vote_as_they_did(spark):
    visits = _visits(spark, 700).withColumn("is_admitted", F.pmod(F.xxhash64("patient_id"), F.lit(5)) + F.col("age") / 30 > 3)
    trained = learning.train_admission(visits, trees=5, folds=0, grove=2, sampled_from=0)
    target = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/model"
    learning.save_model(trained, target)
    assert [PipelineModel.load(f"{target}/{g}").stages[1].getNumTrees for g in range(3)] == trained.model.trees == [2, 2, 1]
    votes, test = {}, trained.data.where("is_test")
    models = list(trained.model.models())
    for model in models:
        for r in model.transform(test).select("patient_id", "rawPrediction").collect():
            votes[r["patient_id"]] = votes.get(r["patient_id"], 0) + r["rawPrediction"].toArray()
    said = {r["patient_id"]: r["prediction"] for r in trained.predictions.collect()}
    assert said == {i: float(v.round(9).argmax()) for i, v in votes.items()} and len(said) == test.count()
    assert sum(m.totalNumNodes for m in models) == trained.model.nodes
    total = sum(m.featureImportances.toArray() * n for m, n in zip(models, trained.model.trees, strict=True))
    assert trained.model.featureImportances == pytest.approx(total / total.sum())


def test_trees_do_not_depend_on_the_layout(spark):
    """Ids that repeat or are missing, and rows that come twice."""
    once = _visits(spark, 300).withColumn("patient_id", F.when(F.col("age") > 5, F.substring("patient_id", 1, 7)))
    rows, seen = once.unionAll(once.limit(40)).persist(), []
    for n in (1, 5):
        trained = learning.train_admission(rows.repartition(n), trees=4, folds=3, grove=3, sampled_from=0)
        seen.append((tuple(trained.metrics.first()), [tuple(r) for r in trained.importances.collect()], trained.model.nodes))
        assert trained.out_of_fold.count() == 340
    assert seen[0] == seen[1]
    rows.unpersist()
