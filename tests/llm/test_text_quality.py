import re
from collections import Counter

import rows

from visitflow.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _measures(text):
    words = WORD.findall(text or "")
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {j for i in range(len(words) - 2) if threes[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(inside))


TEXTS = [
    "a b c a b c", "a a a a", "a a a", "one\ntwo\none\n \n\n", "x # y * z | <>", "ü ö\x0bß é\x0cn", "tab\tand\rreturn",
    " lead and trail ", "a b c d a b x a b c", "\u00a0 no break \u00a0", "same words here\nsame words here",
]


def test_measures_are_those_of_brute_force(spark):
    docs = rows.documents(spark, list(enumerate(TEXTS))).unionByName(rows.odd(spark))
    got = Q.measured(docs).select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in got.collect():
        assert tuple(r)[1:] == _measures(r["text"]), r["text"]


def _prose(i, n=80):
    return " ".join(f"{'abcdefgh'[(i * j) % 8]}word{(i * 31 + j * j) % 997 % 60}" for j in range(n)) + f" end{i}"


def test_junk_of_each_kind_is_told_from_prose(spark):
    good = [(i, _prose(i)) for i in range(160)]
    junk = [
        (1000, " ".join(w + "%%%" for w in _prose(3).split())), (1001, "again and again " * 60),
        (1002, "!! ".join(_prose(5).upper().split())), (1003, "\n".join(["the same line of words"] * 40)),
    ]
    got = {r["doc_id"]: r["posterior"] for r in Q.judged(rows.documents(spark, good + junk)).select(
        "row.doc_id", "posterior").collect()}
    assert all(got[d] >= Q.KEEP for d, _ in good)
    assert all(got[d] < Q.KEEP for d, _ in junk)


def test_odd_rows_and_empty_tables(spark):
    strange = rows.widened(rows.odd(spark))
    got = Q.judged(strange)
    assert got.count() == strange.count()
    assert got.where("posterior IS NULL OR posterior < 0 OR posterior > 1").count() == 0
    assert got.select("row.*").columns == strange.columns
    assert Q.judged(strange.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark, sf_dir):
    from visitflow.llm import registry

    for name in ("op2_licenses", "op3_quality", "op10_url_filter"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan), name
