"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs their votes.

Every rule looks at one measure of the whole text and votes good (1), bad (-1) or not at all (0). Documents with the same
votes are alike, so the model is fitted on the numbers of documents per combination of votes: at most ``3 ** rules``
numbers, however many documents there are. For each class the model holds how often a rule gives each vote - its accuracy
on good and on bad documents - and the share of good documents. Steps of expectation and maximisation start from
``START`` and keep ``WEIGHT`` of it as a Dirichlet prior, as a share of the documents, so that fits behave alike at every
size. The result is the posterior probability that a document is good, instead of a filter that every rule must pass.

All of it is DataFrame expressions: the fit is one row, read through a scalar subquery.

Null texts have no words. Rows are judged one by one, so repeated rows get equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.llm.shared import written

SPACES = " \t\n\x0b\x0c\r"
# --- fixed value: characters that count as symbols -----------------------------------------------------------------
SYMBOLS = "#*$%&|<>"
# --- end of fixed values -------------------------------------------------------------------------------------------
ROUNDS = 25
WEIGHT = 0.5
GOOD_SHARE = 0.8
START = {"good": (0.001, 0.099, 0.9), "bad": (0.25, 0.1, 0.65)}  # bad, no and good votes
KEEP = 0.85  # posterior from which a document is kept

# Rule: measure, a bad vote from this value on, a good vote up to this one.
RULES: tuple[tuple[str, str, float, float], ...] = (
    ("symbols", "n_symbols / n_words", 0.1, 0.02),
    ("word_length", "abs(word_chars / n_words - 5.2)", 2.0, 1.0),
    ("same_lines", "n_dup_lines / n_lines", 0.3, 0.05),
    ("repeats", "n_repeat_words / n_words", 0.4, 0.25),
    ("exclamations", "n_exclamations / n_words", 0.2, 0.02),
    ("capitals", "n_capitals / word_chars", 0.25, 0.08),
    ("length", "1 / n_words", 0.05, 0.02),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where ``body`` uses it for every element of an array."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more: windows sorted by hash, so that equal ones are neighbours."""
    def of(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.struct(
                F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")
            ),
        )
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), covered))

    def covered(s: Column) -> Column:
        twice = F.filter(
            s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
        )
        return let(F.transform(twice, lambda x: x["i"]), lambda at: F.size(F.array_union(
            F.array_union(at, F.transform(at, lambda i: i + 1)), F.transform(at, lambda i: i + 2)
        )))

    return let(words, of)


def _gone(text: Column, characters: str) -> Column:
    """How many of the characters the text holds."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """``row`` (the given row) and the measures of its whole text."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    t = F.col("t")
    words = F.array_remove(F.split(t, "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    counted = rows.select(
        "row",
        let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).cast("bigint").alias("r"))
            ).alias("w"),
        (F.length(t) - _gone(t, SPACES)).cast("bigint").alias("word_chars"),
        _gone(t, SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("d")
        )).alias("l"),
        _gone(t, "!").alias("n_exclamations"),
        F.regexp_count(t, F.lit("\\p{Lu}")).cast("bigint").alias("n_capitals"),
    )
    return counted.select(
        "row", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"),
        F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), "n_exclamations", "n_capitals",
    )


def _code() -> Column:
    """The votes of all rules as digits 0 (bad), 1 (none) and 2 (good) of one number."""
    total = F.lit(0)
    for j, (_, measure, bad, good) in enumerate(RULES):
        value = F.try_divide(*map(F.expr, measure.split(" / "))) if not measure.startswith("abs") else F.abs(
            F.try_divide(F.col("word_chars"), F.col("n_words")) - 5.2)
        digit = F.when(value >= bad, 0).when(value <= good, 2).otherwise(1)
        total = total + digit * 3 ** j
    return total


def _posterior(state: Column, code: Column) -> Column:
    """Probability of a good document with these votes."""
    odds = F.ln(state["share"]) - F.ln(1 - state["share"])
    for j in range(len(RULES)):
        vote = (F.floor(code / 3 ** j) % 3).cast("int")
        odds = odds + F.ln(F.get(F.get(state["good"], F.lit(j)), vote)) - F.ln(
            F.get(F.get(state["bad"], F.lit(j)), vote))
    return 1 / (1 + F.exp(-odds))


def _fit(codes: DataFrame) -> Column:
    """Posterior for every combination of votes, an array that is indexed by their code."""
    counted = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    row = counted.agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("seen"), F.sum("n").alias("total"))
    table = "array<array<double>>"
    start = F.struct(
        F.lit(GOOD_SHARE).alias("share"),
        *[F.array(*[F.array(*map(F.lit, START[c])) for _ in RULES]).cast(table).alias(c) for c in ("good", "bad")],
    )

    def total(items: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda s, x: s + value(x))

    def step(state: Column, _: Column) -> Column:
        def maximised(seen: Column) -> Column:
            good = total(seen, lambda x: x["f"] * x["q"])
            whole = {"good": good, "bad": 1 - good}
            own = {"good": lambda x: x["f"] * x["q"], "bad": lambda x: x["f"] * (1 - x["q"])}

            def votes(c: str) -> Column:
                return F.array(*[
                    F.array(*[
                        (total(F.filter(seen, lambda x: (F.floor(x["code"] / 3 ** j) % 3) == v), own[c])
                         + WEIGHT * START[c][v]) / (whole[c] + WEIGHT)
                        for v in range(3)
                    ])
                    for j in range(len(RULES))
                ]).cast(table).alias(c)

            return F.struct(((good + WEIGHT * GOOD_SHARE) / (1 + WEIGHT)).alias("share"), votes("good"), votes("bad"))

        expected = F.transform("seen", lambda x: F.struct(
            x["code"].alias("code"), (x["n"] / F.col("total")).alias("f"), _posterior(state, x["code"]).alias("q")
        ))
        return let(expected, maximised)

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return row.select(
        let(fitted, lambda s: F.transform(F.sequence(F.lit(0), F.lit(3 ** len(RULES) - 1)), lambda c: _posterior(s, c))
            ).alias("posterior")
    ).scalar()


def judged(docs: DataFrame) -> DataFrame:
    """``row``, the measures, and ``posterior``. The measures are written once; fit and result read them."""
    found = written(measured(docs).withColumn("code", _code()), "measures")
    posterior = F.get(_fit(found.select("code")), F.col("code"))
    return found.withColumn("posterior", posterior).drop("code")
