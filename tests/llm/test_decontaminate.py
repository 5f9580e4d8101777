import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from visitflow.llm import decontaminate as D


def _brute(words, items, window):
    hit, found = set(), set()
    for n, item in enumerate(items):
        size = min(len(item), window)
        if not size:
            continue
        windows = {tuple(item[i:i + size]) for i in range(len(item) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(n)
    return hit, found


_words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(_words, st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), max_size=5), st.integers(1, 5))
def test_automaton_finds_what_brute_force_finds(words, items, window):
    automaton = D.Automaton(items, window)
    number = D.Cache(lambda w: automaton.vocabulary.get(w, -1))
    spans, found = D.matches(D._numbers(words, number), automaton)
    hit = {i for a, b in spans for i in range(a, b + 1)}
    assert (hit, found) == _brute(words, items, window)


ITEMS = ["the quick brown fox jumps over the lazy dog and then runs home again", "Short Item here", "!!", None]


def _benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")


def test_blocks_give_the_same_result(spark):
    docs = rows.documents(spark, [
        (1, "x " + ITEMS[0] + " y"), (2, "a SHORT item, Here; b"), (3, "quick brown fox"), (4, None), (5, ""),
        (6, ITEMS[0] + " " + ITEMS[1]),
    ])
    out = []
    for most in (10_000, 4):
        got = D.matched(docs, _benchmark(spark), most=most).select("row.doc_id", "n_words", "n_hit", "item_ids", "spans")
        out.append(sorted(map(tuple, got.collect())))
    assert out[0] == out[1]
    by = {r[0]: r for r in out[0]}
    assert [by[i][2] for i in range(1, 7)] == [14, 3, 0, 0, 0, 17]
    assert by[6][3] == ["0", "1"]


def test_spans_are_cut_and_covered_documents_go(spark):
    clean = " ".join(f"w{i}" for i in range(40))
    docs = rows.widened(rows.documents(spark, [(1, clean + " " + ITEMS[0] + ". " + clean), (2, ITEMS[0]), (3, clean)]))
    for most in (10_000, 4):
        got = {r["doc_id"]: r["text"] for r in D.decontaminated(docs, _benchmark(spark), most=most).collect()}
        assert got == {1: clean + " \n. " + clean, 3: clean}
    assert D.decontaminated(docs, _benchmark(spark)).columns == docs.columns


def test_window_that_appears_by_cutting_is_cut_too(spark):
    item = "a b c d e f g h i j"
    docs = rows.documents(spark, [(1, "a b c d e " + item + " f g h i j " + "z " * 60)])
    text = D.decontaminated(docs, _benchmark(spark, [item])).first()["text"]
    assert D.words_of(text) == [b"z"] * 60


def test_odd_rows_and_empty_tables(spark):
    strange = rows.odd(spark)
    assert D.matched(strange, _benchmark(spark)).count() == strange.count()
    assert D.matched(strange, _benchmark(spark).limit(0)).where("n_hit > 0").count() == 0
    assert D.matched(strange.limit(0), _benchmark(spark)).count() == 0


def test_repeated_rows_of_an_item_count_once(spark):
    """Equal rows, rows of one id with other texts, and other items of equal text."""
    text = ITEMS[0]
    items = spark.createDataFrame(
        [(7, text), (7, text), (7, text.upper()), (7, "Short Item here"), (8, text), (None, text)],
        "item_id bigint, text string")
    docs = rows.documents(spark, [(1, text + " " + ITEMS[1]), (2, "short item here")])
    for most in (10_000, 4):
        got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in D.matched(docs, items, most=most).select(
            "row.doc_id", "n_hit", "item_ids").collect()}
        assert got == {1: (17, ["", "7", "8"]), 2: (3, ["7"])}


def test_blocks_stay_bounded(spark):
    """Many equal rows and one very long item: no block is far above its size, and nothing is lost."""
    long = [f"l{i}" for i in range(2000)]
    items = spark.createDataFrame(
        [(1, " ".join(long))] + [(i % 3 + 2, "the same words of every row " * 5) for i in range(300)],
        "item_id bigint, text string")
    most, window = 100, 10
    blocks = D.item_blocks(items, most, window).selectExpr("block", "size(split(text, ' ')) AS n").groupBy("block").sum("n")
    assert max(r[1] for r in blocks.collect()) <= 6 * most and blocks.count() > 10
    docs = rows.documents(spark, [(1, "x " + " ".join(long[85:130]) + " y"), (2, " ".join(long[995:1004])),
                                  (3, " ".join(long))])
    whole, cut = (
        sorted((r["doc_id"], r["n_hit"], r["item_ids"]) for r in D.matched(docs, items, window, n).select(
            "row.doc_id", "n_hit", "item_ids").collect())
        for n in (10_000, most)
    )
    assert whole == cut == [(1, 45, ["1"]), (2, 0, []), (3, 2000, ["1"])]
