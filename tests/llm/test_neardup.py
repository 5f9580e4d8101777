import random

import numpy as np
import rows

from visitflow.llm import neardup as N


def _text(rng, n):
    return [f"{rng.choice('abcdefghij')}{rng.randrange(3000)}" for _ in range(n)]


def _corpus(seed=5):
    """Originals with near copies of few changed words, exact copies, and texts that share half their words."""
    rng = random.Random(seed)
    texts, doc = [], 0
    for family in range(25):
        base = _text(rng, rng.randrange(120, 260))
        for copy in range(rng.choice([1, 2, 2, 6])):
            words = list(base)
            for _ in range(copy % 3):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
            texts.append((doc, " ".join(words)))
            doc += 1
        texts.append((doc, " ".join(base[:len(base) // 2] + _text(rng, len(base) // 2))))
        doc += 1
    return texts


def _brute(texts, counts, total):
    weights, number = N.Weights(counts, total), N.word_hashes()
    sets = {}
    for d, t in texts:
        u, n = N.shingles(np.fromiter(map(number.__getitem__, N.words_of(t)), np.uint64, len(N.words_of(t))))
        sets[d] = (u, weights(u, n))
    top = {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and N.weighted_jaccard(sets[a], sets[b]) >= N.SIMILAR:
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: root(d) for d in sets}


def test_classes_are_those_of_all_pairs(spark):
    texts = _corpus()
    docs = rows.documents(spark, texts)
    counts, total = N.sketch(docs)
    got = {r["doc_id"]: r["class_id"] for r in N.classes_of(docs).collect()}
    assert got == _brute(texts, counts, total)


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(7)
    base = _text(rng, 200)
    texts = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(200)] = f"own{i}"
        texts.append((i, " ".join(words)))
    others = [(1000 + i, " ".join(_text(rng, 100))) for i in range(300)]  # the group holds a third of all documents
    found = [r for r in N.classes_of(rows.documents(spark, texts + others)).collect() if r["doc_id"] < 1000]
    assert {r["class_id"] for r in found} == {0} and {r["n_class"] for r in found} == {150}


def test_sampling_agrees_as_often_as_texts_are_alike():
    rng = np.random.default_rng(1)
    sampler = N.Sampler()
    agree = expected = 0
    for _ in range(40):
        u = np.unique(rng.integers(1, 1 << 62, 300).astype(np.uint64))
        w = rng.uniform(0.5, 6, len(u))
        both = rng.random(len(u)) < 0.9
        other = np.where(both, w, w * rng.uniform(0.3, 1, len(u)))
        pair = sampler.bands(
            np.concatenate([u, u]), np.log(np.concatenate([w, other])).astype(np.float32), np.array([len(u)] * 2))
        agree += int((pair[0] == pair[1]).sum())
        expected += N.BANDS * N.weighted_jaccard((u, w), (u, other)) ** N.ROWS
    assert abs(agree - expected) < 4 * expected ** 0.5


def test_one_row_of_each_class_stays(spark):
    docs = rows.widened(rows.odd(spark))
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    # The twelve words occur with a null id, which comes first, and document 8 has one word more; wordless rows are
    # classes of their own.
    assert [g[:2] for g in got] == [(False, 2), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0), (True, 0)]
    assert N.one_of_each(docs.limit(0)).count() == 0
