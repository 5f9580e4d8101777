"""Ball-tree search against scores of all documents."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from visitflow.llm import lexsearch

ITEMS = "item_id bigint, text string"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def plain(docs, items, top=10):
    """Rows ``(item_id, rank, doc_id, score)`` from a score of every document."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(
                floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(terms(text))
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if null else doc, -score))
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def check(spark, docs, items, **options):
    frame = rows.documents(spark, docs)
    found = lexsearch.ranked(frame, spark.createDataFrame(items, ITEMS), **options)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(docs, items), key=key)


VOCABULARY = [f"t{i}" for i in range(40)] + ["ß", "ñandú", "x9"]


def corpus(seed, n):
    r = np.random.default_rng(seed)
    share = 1 / np.arange(1, len(VOCABULARY) + 1)
    texts = [" ".join(r.choice(VOCABULARY, r.integers(0, 60), p=share / share.sum())) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)]


def test_odd_documents_and_items(spark):
    odd = [(r["doc_id"], r["text"]) for r in rows.odd(spark).collect()]
    items = [(1, "One TWO, word5!"), (1, "One TWO, word5!"), (1, "twelve"), (2, None), (3, ""), (4, "--"), (None, "ten"),
             (5, "nowhere"), (6, "x ü")]
    check(spark, odd, items)


def test_extra_columns_and_empty_tables(spark):
    odd = rows.odd(spark)
    items = spark.createDataFrame([(1, "one two")], ITEMS)
    same = [sorted(map(tuple, lexsearch.ranked(d, items).collect()), key=key) for d in (odd, rows.widened(odd))]
    assert same[0] == same[1] != []
    assert lexsearch.ranked(rows.documents(spark, []), items).collect() == []
    assert lexsearch.ranked(odd, spark.createDataFrame([], ITEMS)).collect() == []


@pytest.mark.parametrize("block", [50_000, 60])
def test_many_documents_ties_and_blocks(spark, monkeypatch, block):
    """Several trees, many equal scores at the limit, queries in one block and in many."""
    monkeypatch.setattr(lexsearch, "DOCS", 200)
    monkeypatch.setattr(lexsearch, "LEAF", 8)
    docs = corpus(3, 700)
    docs += [(10_000 - i, docs[5][1]) for i in range(300)] + [(20_000 + i, "t1 t30") for i in range(40)]
    items = [(i, " ".join(VOCABULARY[i % 43:i % 43 + 7])) for i in range(0, 60, 3)] + [(99, docs[5][1])]
    check(spark, docs, items, block_terms=block)


def vectors(seed, n, width):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, width, n)
    own = [np.sort(r.choice(width, s, replace=False)).astype(np.int32) for s in sizes]
    values = [r.integers(1, 1_000_000, s) for s in sizes]
    return np.concatenate(own), np.concatenate(values), sizes, np.arange(n)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300), st.integers(1, 12))
def test_bounds_hold_and_search_is_exact(seed, n, size):
    width = 30
    own, values, sizes, ids = vectors(seed, n, width)
    tree = lexsearch.Tree(own, values, sizes, ids, width)
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), sizes), own] = values
    r = np.random.default_rng(seed + 1)
    query = np.sort(r.choice(width, size, replace=False))
    weight = r.integers(0, 25_000, size)
    scores = dense[:, query] @ weight
    for name, (low, high, _, _) in enumerate(tree.nodes):
        bound = int(tree.centres[name][query] @ weight) + lexsearch._up(int(weight @ weight)) * int(tree.radius[name])
        assert bound >= scores[tree.ids[low:high]].max()
    best = []
    tree.search(query, weight, best, 10)
    want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:10]
    assert sorted(best, reverse=True) == want


def test_subtrees_are_left_out():
    """Documents in far corners: a query for one corner reads few leaves."""
    r = np.random.default_rng(0)
    n, width = 2048, 64
    own = [np.arange(8, dtype=np.int32) + 8 * (i % 8) for i in range(n)]
    sizes = np.full(n, 8)
    values = r.integers(500_000, 510_000, 8 * n)
    tree = lexsearch.Tree(np.concatenate(own), values, sizes, np.arange(n), width)
    best = []
    read = tree.search(np.arange(8), np.full(8, 5000), best, 10)
    assert len(best) == 10 and read < 2048 / lexsearch.LEAF / 2
