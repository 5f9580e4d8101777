"""Product codes against plain distances to all entries."""

import hashlib
from math import floor, inf, isfinite, nan

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitflow.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(vectors, entries=256, rounds=4, parts=4):
    """``(rows (id, codes, error), digest)`` with Python integers."""
    kept = [(i, [floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in vectors
            if v is not None and all(x is not None and isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = {}
    for (i, _, _), c in zip(kept, cut, strict=True):
        first[i] = min(first.get(i, c), c)
    order = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    books = [[first[i][p] for i in order] for p in range(parts)]

    def place(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(place(c[p], books[p])[1], []).append(c[p])
            books[p] = [
                [sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if k in own else e
                for k, e in enumerate(books[p])
            ]
    found = [[place(c[p], books[p]) for p in range(parts)] for c in cut]
    rows = [(i, [k for _, k in f], sum(d for d, _ in f)) for (i, _, _), f in zip(kept, found, strict=True)]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return rows, hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return (row[0] is None, row[0] or 0, row[1], row[2])


def check(spark, vectors, **options):
    found = codes.coded(spark.createDataFrame(vectors, SCHEMA), **options)
    want, digest = plain(vectors, **options)
    have = [(r["row"]["vec_id"], list(r["code"]), r["error"]) for r in found.rows.collect()]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert found.digest() == digest


def test_odd_vectors(spark):
    r = np.random.default_rng(0)
    vectors = [(i, [float(x) for x in r.normal(size=8)], i % 3) for i in range(40)]
    vectors += [(100, None, 1), (101, [None] * 8, 1), (102, [nan] + [0.0] * 7, 1), (103, [0.0] * 7 + [inf], 1),
                (104, [-inf] + [0.0] * 7, None), (105, [], 2), (106, [0.5] * 5, 2), (107, [0.25] * 9, None),
                (None, [0.1] * 8, None), (None, [0.1] * 8, None), (3, [9.0] * 8, 1), (3, [-9.0] * 8, 1)]
    vectors += [vectors[0]] * 5
    check(spark, vectors, entries=16)
    check(spark, vectors)  # more entries than vectors


def test_empty_tables(spark):
    check(spark, [(1, None, 1)])
    check(spark, [(1, [], 1), (2, [], 1)])
    found = codes.coded(spark.createDataFrame([], SCHEMA))
    assert found.rows.collect() == [] and found.books.size == 0


def test_columns_of_clashing_names_are_kept(spark):
    frame = spark.createDataFrame([(i, [float(i)] * 4, None) for i in range(5)], SCHEMA)
    for name in ("row", "id", "ints", "part", "n", "position", "code", "error"):
        frame = frame.withColumn(name, F.lit(name))
    found = codes.with_group_error(codes.coded(frame).rows, F.col("row.label")).collect()
    assert len(found) == 5 and {r["row"]["part"] for r in found} == {"part"}
    assert {r["label_error"] for r in found} == {sum(r["error"] for r in found)}


def test_group_errors_with_null_labels(spark):
    r = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in r.normal(size=8)], [None, 1, 2][i % 3]) for i in range(90)]
    rows = codes.with_group_error(
        codes.coded(spark.createDataFrame(vectors, SCHEMA), entries=4).rows, F.col("row.label")).collect()
    sums = {}
    for row in rows:
        sums[row["row"]["label"]] = sums.get(row["row"]["label"], 0) + row["error"]
    assert len(rows) == 90 and all(row["label_error"] == sums[row["row"]["label"]] for row in rows)


def test_large_components(spark):
    check(spark, [(i, [float(i * 60), -50_000.0, 0.0, 1e-9], 0) for i in range(20)], entries=4)
    huge = codes.coded(spark.createDataFrame([(1, [3e38, -3e38, 0.0, 0.0], 0), (2, [0.0] * 4, 0)], SCHEMA), entries=1)
    assert sorted(r["error"] for r in huge.rows.collect())[0] >= 0


@pytest.mark.parametrize("block", [1, 3, 512])
@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 200), st.integers(1, 4), st.integers(1, 9))
def test_trie_finds_the_nearest_entry(block, seed, n, width, entries):
    r = np.random.default_rng(seed)
    parts, book = r.integers(-3, 3, (n, width)), r.integers(-3, 3, (entries, width))
    before, codes.BLOCK = codes.BLOCK, block
    try:
        found, distance = codes.nearest(parts, book)
    finally:
        codes.BLOCK = before
    plain_distances = ((parts[:, None, :] - book[None]) ** 2).sum(-1)
    assert (found == plain_distances.argmin(1)).all() and (distance == plain_distances.min(1)).all()
