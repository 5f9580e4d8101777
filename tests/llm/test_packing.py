import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from visitflow.llm import packing as P
from visitflow.llm import registry


def _least(lengths, capacity):
    """Fewest sequences, by trying all ways for small cases."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            place(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1:])
        place(i + 1, rooms + [capacity - lengths[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_never_exceeds_the_best_packing(lengths):
    lengths = sorted(lengths, reverse=True)
    sequence, offset = P.best_fit(np.array(lengths), 20)
    assert P.lower_bound(np.array(lengths), 20) <= _least(lengths, 20) <= sequence.max() + 1
    for s in set(sequence.tolist()):
        at = 0
        for i in sorted(np.flatnonzero(sequence == s), key=lambda i: offset[i]):
            assert offset[i] == at
            at += lengths[i]
        assert at <= 20


def test_bound_sees_more_than_the_volume():
    assert P.lower_bound(np.array([600] * 7)) == 7
    assert P.lower_bound(np.array([400] * 6)) == 3


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .,\n\t\r'st1é 　<|>!"), max_size=40))
def test_ids_are_those_of_the_tokenizer(tokenizer, text):
    encode = P.Encoder(registry.VOCABULARY)
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_only_long_documents_are_cut():
    assert P.cuts(1) == [(0, 1)]
    assert P.cuts(1024) == [(0, 1024)]
    assert P.cuts(2050) == [(0, 2), (2, 1024), (1026, 1024)]


def test_pieces_are_whole_and_sequences_gapless(spark, tokenizer):
    rng = random.Random(2)
    texts = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 900)))) for i in range(120)]
    docs = rows.documents(spark, texts).unionByName(rows.odd(spark))
    got = P.packed(docs, registry.VOCABULARY).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, t in texts:
        if d <= 8:  # ids that odd rows have too
            continue
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        ids = b"".join(bytes(r["ids"]) for r in parts)
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [P.END]
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [0, *itertools.accumulate(r["length"] for r in parts)][:-1]
        assert sum(r["length"] for r in parts) <= P.CAPACITY
    lengths = np.array([r["length"] for r in got])
    assert len(by_sequence) <= P.lower_bound(lengths) + 1


def test_many_groups_exchange_sequences(spark):
    rng = random.Random(4)
    rows_ = [(i, i, 0, rng.choice([700, 650, 400, 330, 300, 120])) for i in range(900)]
    lengths = spark.createDataFrame(rows_, "id bigint, doc_id bigint, piece int, length bigint")
    few = P.plan(lengths, group=60)
    used = few.select("sequence_id").distinct().count()
    alone = sum(P.best_fit(np.array([r[3] for r in rows_[i::15]]))[0].max() + 1 for i in range(15))
    assert few.count() == 900 and used < alone
    assert used <= (P.best_fit(np.array([r[3] for r in rows_]))[0].max() + 1) * 1.02
    assert P.plan(lengths.limit(0)).count() == 0


def test_query_checksums(spark, sf_dir, tokenizer):
    from visitflow.llm.shared import table

    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    for r in registry.QUERIES["op1_packing"](spark, sf_dir).collect():
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [P.END]
        own = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
        assert zlib.crc32(own) == r["ids_crc32"]


@pytest.fixture(scope="module")
def encode():
    return P.Encoder(registry.VOCABULARY)


@pytest.fixture(scope="module")
def contract_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([
    "<|endoftext|>", "<|endoftext", "|>", "<|", "endoftext", "a", "b's", " ", "  ", "\n", "\t", "1", "é", "　"]), max_size=12))
def test_added_tokens_have_ids_of_their_own(contract_tokenizer, encode, parts):
    text = "".join(parts)
    assert np.frombuffer(encode(text), "<u4").tolist() == contract_tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_documents(spark, contract_tokenizer):
    texts = [(1, "a <|endoftext|> b"), (2, "<|endoftext|><|endoftext|>"), (3, "x " * 1500 + "<|endoftext|>\n y")]
    found = {}
    for r in sorted(P.packed(rows.documents(spark, texts), registry.VOCABULARY).collect(), key=lambda r: r["start"]):
        found[r["doc_id"]] = found.get(r["doc_id"], b"") + bytes(r["ids"])
    for d, text in texts:
        ids = contract_tokenizer.encode(text, add_special_tokens=False).ids + [P.END]
        assert np.frombuffer(found[d], "<u4").tolist() == ids
    assert np.frombuffer(found[1], "<u4").tolist() == [64, 220, 50256, 275, P.END]


def test_extra_columns_and_empty_tables(spark):
    docs = rows.odd(spark)
    for name in ("piece", "start", "length", "ids", "sequence_id", "offset", "tokens"):
        docs = docs.withColumn(name, rows.F.lit(name))
    plain, wide = (
        sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"]) for r in P.packed(d, registry.VOCABULARY).collect())
        for d in (rows.odd(spark), docs)
    )
    assert plain == wide != []
    assert P.packed(docs.limit(0), registry.VOCABULARY).count() == 0
