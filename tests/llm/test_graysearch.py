"""Gray-order search against all pairs."""

import re

import numpy as np
import pytest
import rows
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from visitflow.llm import graysearch, registry


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, distance=4):
    """The lowest place connected with each fingerprint."""
    top = list(range(len(prints)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    x = np.array(prints, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= distance) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            top[b] = a
    return [root(i) for i in range(len(x))]


def expected(pairs):
    prints = [plain_fingerprint(t) for _, t in pairs]
    classes = plain_classes(prints)
    lowest = {}
    for (doc, _), c in zip(pairs, classes, strict=True):
        if doc is not None:
            lowest[c] = min(doc, lowest.get(c, doc))
    return [(d, f"{p:016x}", lowest.get(c)) for (d, _), p, c in zip(pairs, prints, classes, strict=True)]


def key(row):
    return tuple((v is None, v or 0) if not isinstance(v, str) else v for v in row)


def found(frame):
    return [(r["doc_id"], f"{r['fingerprint'] % (1 << 64):016x}", r["component_id"]) for r in frame.collect()]


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    have = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in registry.op11_simhash(spark, sf_dir).collect()]
    assert sorted(have, key=key) == sorted(want, key=key)


def test_odd_rows_and_clashing_columns(spark):
    odd = rows.odd(spark)
    want = sorted(expected([(r["doc_id"], r["text"]) for r in odd.collect()]), key=key)
    assert sorted(found(graysearch.linked(odd)), key=key) == want
    assert sorted(found(graysearch.linked(rows.widened(odd))), key=key) == want


def test_empty_table(spark):
    assert found(graysearch.linked(rows.documents(spark, []))) == []


def _clouds(seed, clouds=3, size=120, alone=200):
    """Fingerprints around a few centres, up to five bits away, and others anywhere."""
    r = np.random.default_rng(seed)
    out = list(r.integers(0, 1 << 64, alone, dtype=np.uint64))
    for centre in r.integers(0, 1 << 64, clouds, dtype=np.uint64):
        for _ in range(size):
            bits = r.choice(64, r.integers(0, 6), replace=False)
            out.append(centre ^ np.uint64(sum(1 << int(b) for b in bits)))
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("piece", [4096, 16])
def test_large_groups_over_many_pieces(spark, monkeypatch, piece):
    """Groups of near copies in one piece, and cut into many: links across pieces are found, too."""
    monkeypatch.setattr(graysearch, "PIECE", piece)
    prints = _clouds(1)
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint bigint")
    index = graysearch.written(graysearch.index_of(frame), "index")
    within = graysearch.links_within(index)
    classes = graysearch.components(within)
    between = graysearch.links_between(index, classes)
    assert (between is not None) == (piece == 16)
    links = within if between is None else within.union(between)
    top = {p: p for p in prints.view(np.int64).tolist()}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links.collect():
        assert (a ^ b).bit_count() <= 64
        top[root(a)] = root(b)
    classes = plain_classes(prints.tolist())
    want = {}
    for p, c in zip(prints.view(np.int64).tolist(), classes, strict=True):
        want.setdefault(c, set()).add(p)
    have = {}
    for p in top:
        have.setdefault(root(p), set()).add(p)
    assert sorted(map(sorted, have.values())) == sorted(map(sorted, want.values()))
    # A spanning tree for each piece, never all pairs.
    assert within.count() <= 5 * len(prints)


def test_classes_in_spark_match_all_pairs(spark, monkeypatch):
    """Whole operator on texts whose fingerprints lie close together."""
    monkeypatch.setattr(graysearch, "PIECE", 8)
    base = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join([*base[:j], f"x{i}", *base[j + 1:]])) for i, j in enumerate(range(5, 285, 4))]
    texts += [(1000 + i, f"alone {i} " * 3) for i in range(20)] + [(2000 + i, texts[0][1]) for i in range(30)]
    assert sorted(found(graysearch.linked(rows.documents(spark, texts))), key=key) == sorted(expected(texts), key=key)


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=50))
def test_gray_order_is_a_walk_by_single_bits(values):
    x = np.array(values, np.uint64)
    assert (graysearch.gray_code(graysearch.gray_rank(x)) == x).all()
    ranks = graysearch.gray_rank(x)
    after = graysearch.gray_code(ranks + np.uint64(1))
    assert (np.bitwise_count(after ^ x) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1000), st.integers(0, 4), st.integers(1, 12))
def test_forest_finds_what_all_pairs_find(seed, distance, pieces):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 64, 3, dtype=np.uint64)
    near = [c ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(d)) for c in centres for b, d in r.integers(0, 64, (20, 2))]
    ranks = np.sort(graysearch.gray_rank(np.unique(np.array(near, np.uint64))))
    code = graysearch.gray_code(ranks)
    starts = np.unique(np.concatenate([[0], r.integers(0, len(code), pieces - 1)]))
    forest, classes = graysearch.Forest(code, starts), graysearch.Classes(len(code))
    piece = np.searchsorted(starts, np.arange(len(code)), side="right") - 1
    forest.connect(code, piece, np.arange(len(code)), classes, distance, later=True)
    for low, high in zip(starts, np.append(starts[1:], len(code)), strict=True):
        want = np.array(plain_classes(code[low:high].tolist(), distance)) + low
        assert (classes.of[low:high] == want).all()
