"""Benchmark passages in training texts, found by a generalised suffix automaton over the words of the test items.

All items of a block become one automaton: its states stand for sets of positions in items, and reading a text word by
word keeps the longest run of words, ending here, that occurs in some item. A *window* is ``WINDOW`` consecutive words of
an item, or a whole shorter item; wherever the matching length reaches a window, its words in the text are hit.

Blocks hold about ``BLOCK_WORDS`` words of distinct items (longer ones are cut into overlapping stretches), so each broadcast automaton has a bounded size however large the
benchmark is; every text is read against every block. Words are the maximal runs of ASCII letters, digits and all
characters from 0x80, ASCII letters in lower case.

Null and empty texts have no words; items without words have no window; items with equal text each count, repeated rows
of one item once, and the rows of one id are one item. Documents are judged one by one, so repeated rows get equal
results. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.shared import Cache, text_slices, travels, written

travels(__name__)

WINDOW = 10
BLOCK_WORDS = 200_000
COVERAGE = 0.5  # share of hit words from which a whole document goes

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
MATCH = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<first:int,last:int>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LETTERS).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the windows that end in each state.

    ``run`` follows a sequence of word numbers and returns, per window length reached, what was found.
    """

    def __init__(self, items: list[list[bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        sequences = [[number(w, len(self.vocabulary)) for w in words] for words in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]  # (item, words read) of the positions added at a state
        for item, sequence in enumerate(sequences):
            at = 0
            for read, word in enumerate(sequence, 1):
                at = self._extended(at, word)
                while len(ends) < len(self.next):
                    ends.append([])
                ends[at].append((item, read))
        self._windows(sequences, ends, window)
        pairs = {a * len(self.vocabulary) + b for s in sequences for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.shortest = min((min(len(s), window) for s in sequences if s), default=0)

    def _extended(self, last: int, word: int) -> int:
        """Append a word after state ``last``; an existing state is shared, or split off when it also ends longer runs."""
        to, link, length = self.next, self.link, self.length
        if word in to[last]:
            target = to[last][word]
            return target if length[target] == length[last] + 1 else self._split(last, word, target)
        new = self._state(length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in to[at]:
            to[at][word] = new
            at = link[at]
        if at >= 0:
            target = to[at][word]
            link[new] = target if length[target] == length[at] + 1 else self._split(at, word, target)
        return new

    def _state(self, length: int, to: dict[int, int], link: int) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, word: int, target: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _windows(self, sequences, ends, window: int) -> None:
        """Per state: the longest window that its runs end with, the items of all such windows, and their lengths.

        The state that represents a window of length n is the ancestor whose runs include length n; the items with that
        window are those with a position below it. Each (window, item) is noted once, so the notes are no longer than
        the items.
        """
        found: dict[int, dict[int, set[int]]] = {}  # state of the window -> length -> items
        for state, places in enumerate(ends):
            for item, read in places:
                size = min(len(sequences[item]), window)
                if read >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    found.setdefault(at, {}).setdefault(size, set()).add(item)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        # Windows that end in a state or in one of its suffixes: (length, items), ascending; shared along the links.
        self.windows: list[tuple] = [()] * len(self.next)
        for state in order:
            own = tuple(sorted((n, frozenset(items)) for n, items in found.get(state, {}).items()))
            above = self.windows[self.link[state]]
            self.windows[state] = above + own if own else above

    def run(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges ``(first, last)`` in order of ``last`` and the items whose windows occur."""
        to, link, length, windows = self.next, self.link, self.length, self.windows
        at = matched = 0
        hits, items, seen = [], set(), set()
        for i, word in enumerate(words):
            while at and word not in to[at]:
                at = link[at]
                matched = length[at]
            if word in to[at]:
                at = to[at][word]
                matched += 1
            else:
                matched = 0
            here = windows[at]
            if here:
                reached = [(n, its) for n, its in here if n <= matched]
                if reached:
                    hits.append((i - reached[-1][0] + 1, i))
                    if (at, len(reached)) not in seen:
                        seen.add((at, len(reached)))
                        for _, its in reached:
                            items |= its
        return hits, items


def _candidates(numbers: np.ndarray, automaton: Automaton) -> list[tuple[int, int]]:
    """Ranges of words all of whose neighbours are neighbours in some item, long enough for a window.

    No window can reach beyond such a range, so the automaton need not read the rest.
    """
    n = len(numbers)
    if automaton.shortest == 0 or n < automaton.shortest:
        return []
    known = numbers >= 0
    joined = np.zeros(n - 1, bool) if n else np.zeros(0, bool)
    both = np.flatnonzero(known[:-1] & known[1:])
    keys = numbers[both] * len(automaton.vocabulary) + numbers[both + 1]
    place = np.searchsorted(automaton.pairs, keys)
    if len(automaton.pairs):
        joined[both] = automaton.pairs[np.minimum(place, len(automaton.pairs) - 1)] == keys
    if automaton.shortest == 1:
        starts = np.flatnonzero(known & ~np.concatenate([[False], joined]))
        stops = np.flatnonzero(known & ~np.concatenate([joined, [False]]))
        return list(zip(starts.tolist(), (stops + 1).tolist(), strict=True))
    edges = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
    long = stops - starts >= automaton.shortest
    return list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))


def matches(numbers: np.ndarray, automaton: Automaton) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged ranges of hit words and the items with windows in the text."""
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    for low, high in _candidates(numbers, automaton):
        hits, found = automaton.run(numbers[low:high].tolist())
        items |= found
        for first, last in sorted(hits):
            first, last = first + low, last + low
            if spans and first <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(last, spans[-1][1]))
            else:
                spans.append((first, last))
    return spans, items


def item_blocks(benchmark: DataFrame, most: int = BLOCK_WORDS, window: int = WINDOW) -> DataFrame:
    """Distinct items with words, dealt to blocks of about ``most`` words by their hash: ``block``, ``item_id``, ``text``.

    Repeated rows are one item. An item longer than ``most`` is cut into stretches that share ``window - 1`` words with the
    next, so that they hold the item's windows and no others, and each goes to a block of its own.
    """
    plain = F.trim(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", plain.alias("plain")).where(
        F.col("plain") != "").distinct().select("item_id", F.split("plain", " ").alias("words"))
    long, n = max(most, window), F.size("words")
    starts = F.sequence(F.lit(0), n - window, F.lit(long - window + 1))
    cut = F.transform(starts, lambda start: F.slice("words", start + 1, F.lit(long)))
    stretches = items.select("item_id", F.explode(F.when(n > long, cut).otherwise(F.array("words"))).alias("words"))
    total = int(stretches.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).first()["n"])
    blocks = 1 if total <= most else -(-total * 5 // (4 * most))
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int")
    return stretches.select(block.alias("block"), "item_id", F.array_join("words", " ").alias("text"))


def _dealt(benchmark: DataFrame, most: int, window: int) -> tuple[DataFrame, list[int]]:
    """The items and the numbers of their blocks; an empty benchmark has one empty block."""
    items = item_blocks(benchmark, most, window)
    blocks = sorted(r["block"] for r in items.select("block").distinct().collect()) or [0]
    return written(items, "items") if len(blocks) > 1 else items, blocks


def _automaton(items: DataFrame, block: int, window: int) -> tuple[list[str], Automaton]:
    rows = items.where(F.col("block") == block).select("item_id", "text").collect()
    ids = [str(r["item_id"]) if r["item_id"] is not None else "" for r in rows]
    return ids, Automaton([words_of(r["text"]) for r in rows], window)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_WORDS) -> DataFrame:
    """``row`` (the given row), ``n_words``, ``spans`` of hit words, ``n_hit`` and ``item_ids`` (as texts, sorted).

    One block of items is on the driver and in the workers at a time; with several, the rows are written between them.
    """
    return _matched(docs, *_dealt(benchmark, most, window), window)


def _matched(docs: DataFrame, items: DataFrame, blocks: list[int], window: int) -> DataFrame:
    spark = docs.sparkSession
    out = docs.select(
        F.struct("*").alias("row"),
        F.lit(None).cast("bigint").alias("n_words"),
        F.array().cast("array<string>").alias("item_ids"),
        F.array().cast("array<struct<first:int,last:int>>").alias("spans"),
    )
    for block in blocks:
        ids, automaton = _automaton(items, block, window)
        verdict = _reader(spark, automaton, ids)(F.col("row.text"))
        out = out.withColumn("found", verdict).select(
            "row",
            F.col("found.n_words").alias("n_words"),
            F.concat("item_ids", "found.item_ids").alias("item_ids"),
            F.concat("spans", "found.spans").alias("spans"),
        )
        if len(blocks) > 1:
            out = written(out, "matched")
    merged = F.aggregate(
        F.array_sort("spans"), F.array().cast("array<struct<first:int,last:int>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["first"] <= F.element_at(done, -1)["last"] + 1),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(
                    F.element_at(done, -1)["first"].alias("first"),
                    F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    ) if len(blocks) > 1 else F.col("spans")
    out = out.withColumn("spans", merged)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["last"] - x["first"] + 1)
    return out.select("row", "n_words", "spans", hit.alias("n_hit"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))


def _shipped(spark, automaton: Automaton):
    """The automaton as a broadcast of plain lists, and the function that puts it together in a worker."""
    names = ("vocabulary", "next", "link", "length", "windows", "pairs", "shortest")
    state = spark.sparkContext.broadcast({name: getattr(automaton, name) for name in names})

    def unpacked() -> tuple[Automaton, Cache]:
        own = Automaton.__new__(Automaton)
        own.__dict__.update(state.value)
        return own, Cache(lambda word: own.vocabulary.get(word, -1))

    return unpacked


def _numbers(words: list[bytes], number: Cache) -> np.ndarray:
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _reader(spark, automaton: Automaton, ids: list[str]):
    unpacked, names = _shipped(spark, automaton), spark.sparkContext.broadcast(ids)

    @F.pandas_udf(MATCH)
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, number = unpacked()
        for part in texts:
            values, out = part.tolist(), []
            for low, high in text_slices(values):
                for value in values[low:high]:
                    words = words_of(value)
                    spans, items = matches(_numbers(words, number), own)
                    out.append((len(words), sum(b - a + 1 for a, b in spans), [names.value[i] for i in items],
                                [{"first": a, "last": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "item_ids", "spans"])

    return read


def _cutter(spark, automaton: Automaton):
    unpacked = _shipped(spark, automaton)

    @F.pandas_udf("clean string, n_words bigint, n_cut bigint")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, number = unpacked()
        for part in texts:
            out = []
            for value in part.tolist():
                words, clean, gone = words_of(value), None, 0
                n = len(words)
                while spans := matches(_numbers(words, number), own)[0]:
                    gone += sum(b - a + 1 for a, b in spans)
                    clean = without_words(value if clean is None else clean, spans)
                    words = words_of(clean)
                out.append((clean, n, gone))
            yield pd.DataFrame(out, columns=["clean", "n_words", "n_cut"])

    # Told to be unrepeatable, it is not computed once for a filter and once more for the rows that pass.
    return cut.asNondeterministic()


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each range; a line break stays in place."""
    raw = text.encode("utf-8", "replace")
    letters = np.frombuffer(raw.translate(_LETTERS), np.uint8) != 32
    edges = np.diff(np.concatenate([[0], letters.astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    kept, at = [], 0
    for first, last in spans:
        kept.append(raw[at:starts[first]])
        at = int(stops[last])
    kept.append(raw[at:])
    return b"\n".join(kept).decode("utf-8", "replace")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, most: int = BLOCK_WORDS
) -> DataFrame:
    """All columns; hit spans are cut out, and a document goes when at least ``coverage`` of its words are hit.

    Cutting can bring the two ends of another window together, so a text is read again until nothing is hit. With
    several blocks, the spans of all blocks are cut together and the rows are written before they are read again.
    """
    spark, columns = docs.sparkSession, docs.columns
    items, blocks = _dealt(benchmark, most, window)
    out = docs.select(
        F.struct("*").alias("given"), "text", F.lit(None).cast("bigint").alias("n_words"),
        F.lit(0).cast("bigint").alias("n_cut"),
    )
    if len(blocks) == 1:
        _, automaton = _automaton(items, blocks[0], window)
        out = out.withColumn("now", _cutter(spark, automaton)(F.col("text"))).select(
            "given", F.coalesce("now.clean", "text").alias("text"), "now.n_words", "now.n_cut")
    again, without = len(blocks) > 1, F.pandas_udf(_without, "string")
    while again:
        found = _matched(out, items, blocks, window)
        cut = F.when(F.size("spans") > 0, without("row.text", "spans")).otherwise(F.col("row.text"))
        out = written(found.select(
            "row.given", cut.alias("text"), F.coalesce("row.n_words", "n_words").alias("n_words"),
            (F.col("row.n_cut") + F.col("n_hit")).alias("n_cut"), (F.col("n_hit") > 0).alias("changed"),
        ), "decontaminated")
        again = not out.where("changed").isEmpty()
        out = out.drop("changed")
    kept = out.where((F.col("n_cut") == 0) | (F.col("n_cut") < coverage * F.col("n_words")))
    return kept.select(*[
        F.col("text") if c == "text" else F.col(f"given.{_quoted(c)}").alias(c) for c in columns
    ])


def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    cut = [
        without_words(text, [(x["first"], x["last"]) for x in own]) if text and own is not None and len(own) else text
        for text, own in zip(texts, spans, strict=True)
    ]
    return pd.Series(cut, dtype=object)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
