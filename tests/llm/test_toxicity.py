import numpy as np
import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitflow.llm import registry, toxicity
from visitflow.llm.shared import table


def _all_maximal(scores):
    """By the definition: recursively the best segment, the shortest of equal ones, then those left and right of it.

    A proper part of a maximal segment scores less than the whole, so of equal scores the shorter segment is maximal.
    """
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9 or at and total > best - 1e-9 and j + 1 - i < at[1] - at[0]:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    left, right = _all_maximal(scores[:at[0]]), _all_maximal(scores[at[1]:])
    return left + [(*at, best)] + [(a + at[1], b + at[1], s) for a, b, s in right]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-2.0, -1.0, -0.5, 0.25, 1.0, 3.0]), max_size=24))
def test_segments_have_the_best_total_and_do_not_overlap(scores):
    found = toxicity.segments(np.array(scores))
    expected = _all_maximal(scores)
    assert sorted(round(s, 6) for *_, s in found) == sorted(round(s, 6) for *_, s in expected)
    for (_, end, _), (start, _, _) in zip(sorted(found), sorted(found)[1:], strict=False):
        assert end <= start
    for a, b, s in found:
        assert abs(sum(scores[a:b]) - s) < 1e-6


def test_of_equal_segments_the_shorter_are_maximal():
    assert sorted(toxicity.segments(np.array([1.0, 1.0, -2.0, 3.0]))) == [(0, 2, 2.0), (3, 4, 3.0)]
    assert sorted(toxicity.segments(np.array([1.0, -1.0, 1.0]))) == [(0, 1, 1.0), (2, 3, 1.0)]


def _labelled(spark, n=240):
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"plain{(i * 7 + j * j) % 300}" for j in range(60)]
        if toxic:
            for j in (5, 20, 40):
                words[j] = ("vilest", "rotten", "filthy")[(i + j) % 3]
        texts.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows.documents(spark, texts), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_texts_are_told_apart(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, registry.usable_labels(labels))
    got = toxicity.scored(docs, model).join(labels, F.col("row.doc_id") == labels.doc_id).select(
        "toxic", "score", F.crc32(labels.doc_id.cast("string").cast("binary")).alias("c"), "passages").collect()
    held = [r for r in got if r["c"] % 3 == 1]
    right = sum((r["score"] >= toxicity.REJECT) == bool(r["toxic"]) for r in held)
    assert right / len(held) > 0.95
    assert all(r["passages"] for r in held if r["toxic"] and r["score"] >= toxicity.REJECT)


def test_odd_rows_and_columns(spark):
    docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels)
    strange = rows.odd(spark)
    got = toxicity.scored(strange, model).select("row.doc_id", "row.text", "score").collect()
    assert len(got) == strange.count()
    assert all(0 <= r["score"] <= 1 for r in got)
    same = {r["score"] for r in got if not (r["text"] or "").strip()}
    assert len(same) == 1
    wide = rows.widened(docs)
    kept = toxicity.without_toxic(wide, labels)
    assert kept.columns == wide.columns
    assert 0 < kept.count() < docs.count()


def test_without_labels_nothing_is_rejected(spark):
    docs, labels = _labelled(spark, 40)
    assert toxicity.fit(docs, labels.where("toxic = 1")) is None
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.without_toxic(docs.limit(0), labels).count() == 0


def test_query_does_not_use_held_out_labels(spark, sf_dir):
    labels = registry.usable_labels(table(spark, sf_dir, "labels"))
    assert labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).count() == 0
    got = registry.QUERIES["op8_toxicity"](spark, sf_dir)
    assert got.count() == table(spark, sf_dir, "documents").count()
    assert got.where("predicted <> cast(score >= 0.7 as int)").count() == 0


def test_rows_learned_from_are_bounded_and_differ(spark):
    """One id with very many rows: equal ones count once, different ones are bounded like those of other ids."""
    docs = rows.documents(spark, [(1, "the same text")] * 500 + [(1, f"text {i}") for i in range(500)]
                          + [(i, f"other {i}") for i in range(2, 60)] + [(3, None), (None, "no id")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 1), (2, None), (None, 1)],
                                   "doc_id bigint, toxic int")
    found = toxicity.training_rows(docs, labels)
    assert found.count() == found.select("text").distinct().count() == 1 + 500 + 58
    assert {r["label"] for r in found.where("text = 'the same text'").collect()} == {1}
    assert toxicity.training_rows(docs, labels, 100).count() == 100
