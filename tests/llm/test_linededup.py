import random

import rows

from visitflow.llm import linededup as L


def _line(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n))


def _corpus(seed=1, docs=60):
    """Texts of own lines, some of which share one passage of 5 lines and some one very long line."""
    rng = random.Random(seed)
    passage = [_line(rng, 12) for _ in range(5)]
    long = _line(rng, 60)
    out = []
    for i in range(docs):
        lines = [_line(rng, rng.randrange(4, 15)) for _ in range(rng.randrange(4, 20))]
        at = rng.randrange(len(lines) + 1)
        lines[at:at] = passage if i % 3 == 0 else [long] if i % 3 == 1 else []
        out.append((i, "\n".join(lines)))
    return out, passage, long


def test_shared_passages_stay_once(spark):
    texts, passage, long = _corpus()
    got = {r["doc_id"]: r["text"] for r in L.without_copies(rows.documents(spark, texts)).collect()}
    assert set(got) == {d for d, _ in texts}
    assert sum("\n".join(passage) in t for t in got.values()) == 1 and "\n".join(passage) in got[0]
    assert sum(long in t.split("\n") for t in got.values()) == 1 and long in got[1].split("\n")
    for d, t in texts:
        own = [x for x in t.split("\n") if x not in passage and x != long]
        left = [x for x in got[d].split("\n") if x not in passage and x != long]
        assert own == left
    lines = [x for t in got.values() for x in t.split("\n")]
    assert all(lines.count(x) == 1 for x in passage)


def test_copies_go_and_odd_rows_stay(spark):
    text = "\n".join(f"line number {i} with a few more words of its own" for i in range(8))
    docs = rows.documents(spark, [(1, text), (2, text), (3, None), (4, ""), (1, text), (None, "short\nlines")])
    got = L.without_copies(rows.widened(docs))
    assert got.columns == rows.widened(docs).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [
        (False, 1), (False, 1), (False, 3), (False, 4), (True, 0)]
    strange = rows.odd(spark)
    assert L.deduplicated(strange).count() == strange.count()
    assert L.deduplicated(strange.limit(0)).count() == 0


def test_common_short_lines_stay(spark):
    docs = rows.documents(spark, [(i, f"Header line.\nMenu.\nthis is text number {i} of its own kind {i * i}")
                                  for i in range(20)])
    assert L.deduplicated(docs).where("size(gone) > 0").count() == 0


def test_boundaries_do_not_depend_on_what_is_before(spark):
    rng = random.Random(3)
    hashes = [rng.getrandbits(63) for _ in range(200)]
    words = [8] * 200
    whole = {b for _, b in L.chunk_bounds(hashes, words)}
    shifted = {b + 37 for _, b in L.chunk_bounds(hashes[37:], words[37:])}
    assert {b for b in whole if b > 37 + L.ROLL} == {b for b in shifted if b > 37 + L.ROLL}


def test_short_paragraphs_set_apart_by_empty_lines(spark):
    rng = random.Random(5)
    passage = [_line(rng, n) for n in (7, 3, 19, 5, 2, 9)]
    own = {i: [_line(rng, rng.randrange(2, 20)) for _ in range(8)] for i in range(30)}
    texts = [(i, "\n\n".join(p[:4] + passage + p[4:])) for i, p in own.items()]
    got = {r["doc_id"]: r["text"] for r in L.without_copies(rows.documents(spark, texts)).collect()}
    assert got[0] == texts[0][1]
    for i in range(1, 30):
        assert [x for x in got[i].split("\n") if x] == own[i]


def _shortest_ranges(words):
    """Every repeated range that counts is the union of these: from each line with words on, and up to it."""
    at = [i for i, n in enumerate(words) if n]
    found = set()
    for s in range(len(at)):
        for way in (range(s, len(at)), range(s, -1, -1)):
            total = 0
            for k in way:
                total += words[at[k]]
                if total >= L.LONG or total >= L.SHORT and k != s:
                    found.add((at[min(s, k)], at[max(s, k)] + 1))
                    break
    return sorted(found)


def _brute(texts):
    """Lines with words, of each text, in a range that counts and stands earlier."""
    seen, gone = {}, {}
    for d, text in texts:
        lines = text.split("\n")
        gone[d] = set()
        for a, b in _shortest_ranges([len(x.split()) for x in lines]):
            passage = tuple(lines[a:b])
            if seen.setdefault(passage, (d, a)) != (d, a):
                gone[d].update(i for i in range(a, b) if lines[i].split())
    return gone


def _found(spark, docs, texts):
    got = L.deduplicated(docs).select("row.doc_id", "gone").collect()
    lines = {d: t.split("\n") for d, t in texts}
    return {r["doc_id"]: {i for i in r["gone"] if lines[r["doc_id"]][i].split()} for r in got if r["doc_id"] in lines}


def _words(texts, gone):
    return sum(len(t.split("\n")[i].split()) for d, t in texts for i in gone[d])


def test_only_repeated_passages_go(spark):
    """Texts with so many lines in common that hardly any passage has edges of its own."""
    rng = random.Random(6)
    some = [_line(rng, n) for n in (1, 1, 2, 3, 5, 8, 11, 12, 19, 20, 30)] + ["", "", " "]
    texts = [(i, "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 25)))) for i in range(60)]
    seen = {}
    for d, text in texts:
        for i, line in enumerate(text.split("\n")):
            seen.setdefault(line, (d, i))
    for d, lines in _found(spark, rows.documents(spark, texts), texts).items():
        assert all(seen[dict(texts)[d].split("\n")[i]] < (d, i) for i in lines)


def test_recall_of_repeated_words(spark, sf_dir):
    """Against all ranges of the documents: nothing else goes, and nine tenths of the repeated words at least."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want, have = _brute(texts), _found(spark, docs, texts)
    assert all(have[d] <= want[d] for d, _ in texts)
    assert _words(texts, have) >= 0.9 * _words(texts, want) > 0


def test_planted_passages_of_all_shapes_are_found_whole(spark):
    """Passages of over 50 words, in lines of 4 to 60 words, with and without empty lines, in 8 texts each."""
    rng = random.Random(8)
    texts, planted = [], []
    for p in range(40):
        size = rng.choice((4, 6, 9, 14, 25, 60))
        passage = [_line(rng, max(2, size + rng.randrange(-2, 3))) for _ in range(60 // size + 1)]
        gap = rng.choice(("\n", "\n\n"))
        planted.append(passage)
        for i in range(8):
            own = [_line(rng, rng.randrange(3, 25)) for _ in range(rng.randrange(2, 12))]
            at = rng.randrange(len(own) + 1)
            texts.append((p * 8 + i, gap.join(own[:at] + passage + own[at:])))
    got = {r["doc_id"]: r["text"].split("\n") for r in L.without_copies(rows.documents(spark, texts)).collect()}
    copies = [(p, p * 8 + i) for p in range(40) for i in range(1, 8)]
    whole = sum(not set(planted[p]) & set(got[d]) for p, d in copies)
    assert whole >= 0.95 * len(copies)
    for p in range(40):
        assert set(planted[p]) <= set(got[p * 8])
    for d, text in texts:
        own = [x for x in text.split("\n") if x not in planted[d // 8] and x]
        assert [x for x in got[d] if x in own] == own
