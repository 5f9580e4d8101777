"""Exact ranked lexical search by inner products over sparse ball-trees.

A score is the inner product of a query (the weights of its terms) and a document (for each term a number that grows with
the term's occurrences and falls with the document's length). All numbers are integers:

* ``N`` documents with a term, ``L`` all their terms, ``n`` a document's terms, ``df`` documents with the term, ``tf`` its
  occurrences in the document; repeats count in ``L``, ``n`` and ``tf``.
* weight ``floor(1000 ln((2N + 2) / (2df + 1)))``, length ``m = 10 + 90nN div L``,
  document ``10^9 tf div (1000tf + 8m)``.

Queries are read in blocks of at most ``BLOCK_TERMS`` terms (a longer query is a block of its own). For a block, one pass
over all texts leaves each document's counts of the block's terms, and the document frequencies follow from these. Tasks
then build a ball-tree over every ``DOCS`` documents: a node has a whole-number centre and a radius rounded up, so that
``<query, centre> + |query| * radius``, each factor rounded up, is never below the score of a document in it. A query
takes the nodes best-first and ends when no bound reaches its ``TOP``-th score so far, which later trees of the task start
from; at the leaves, scores are exact sums of integers. Each task leaves at most ``TOP`` rows a query, and these are
ranked.

Terms are the maximal runs of ASCII letters, digits and all characters from 0x80, ASCII letters in lower case. Null and
empty texts have none: such a document is never found, such a query finds nothing. Equal scores are ranked by document
id (nulls last); repeated documents are ranked each, queries equal in id and text are one. Empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitflow.llm.shared import travels, written

travels(__name__)

TOP = 10
BLOCK_TERMS = 50_000  # different terms of all queries that are searched together
DOCS = 4096  # documents of a tree
LEAF = 64  # documents that are scored together
LAST = np.iinfo(np.int64).max  # stands for a null id in comparisons

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


# --- queries ------------------------------------------------------------------------------------------------------

def query_blocks(queries: DataFrame, most: int = BLOCK_TERMS) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Queries with their different terms, in blocks of at most ``most`` terms; the driver holds one partition."""
    rows = queries.select(
        F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        terms = list(dict.fromkeys(terms_of(row["text"] and bytes(row["text"]))))
        if block and size + len(terms) > most:
            yield block
            block, size = [], 0
        if terms:
            block.append((row["item_id"], terms))
            size += len(terms)
    if block:
        yield block


# --- documents ----------------------------------------------------------------------------------------------------

def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id``, ``n`` terms, and ascending ``terms`` of the vocabulary with their ``times``, of every row with terms."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shipped.value.get
        for batch in batches:
            texts, place, sizes, found, times = batch.column("bytes"), [], [], [], []
            for i in range(len(texts)):
                words = terms_of(texts[i].as_py())
                if words:
                    known = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                    own, count = np.unique(known[known >= 0], return_counts=True)
                    place.append(i)
                    sizes.append(len(words))
                    found.append(own)
                    times.append(count)
            if place:
                ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(place)), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times).astype(np.int64), pa.int64())),
                ], names=["doc_id", "n", "terms", "times"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("bytes"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<bigint>")


def _document_counts(width: int):
    """Documents of each term, one row for each term that a task has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=width)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["term", "df"])

    return run


def weights(vectors: DataFrame, width: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term, number of documents, and number of their terms."""
    total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    rows = vectors.select("terms").mapInArrow(_document_counts(width), "term int, df bigint").groupBy("term").agg(
        F.sum("df").alias("df")).collect()  # at most one row for each term of the block
    frequency = np.zeros(width, np.int64)
    for row in rows:
        frequency[row["term"]] = row["df"]
    above = 2 * total["docs"] + 2
    values = [floor(1000 * log(above / (2 * df + 1))) for df in frequency.tolist()]
    return np.array(values, np.int64), total["docs"], total["terms"] or 0


# --- trees --------------------------------------------------------------------------------------------------------

def _up(square: int) -> int:
    """A whole number not below the root of a whole number."""
    root = int(float(square) ** 0.5)
    while root * root < square:
        root += 1
    return root


class Tree:
    """Ball-tree over sparse rows of positive integers; rows are put in the order of the leaves."""

    def __init__(self, terms: np.ndarray, values: np.ndarray, sizes: np.ndarray, ids: np.ndarray, width: int) -> None:
        self.width = width
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        square = np.add.reduceat(values * values, starts)
        order = np.arange(len(sizes))
        self.nodes: list[tuple[int, int, int, int]] = []  # first and last row, children
        centres, radius = [], []

        def product(rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
            at, first = _entries(starts[rows], sizes[rows])
            return np.add.reduceat(dense[terms[at]] * values[at], first)

        def dense(row: int) -> np.ndarray:
            out = np.zeros(width, np.int64)
            out[terms[starts[row]:starts[row] + sizes[row]]] = values[starts[row]:starts[row] + sizes[row]]
            return out

        def grow(low: int, high: int) -> int:
            rows = order[low:high]
            at, _ = _entries(starts[rows], sizes[rows])
            # Sums stay below 2^53 (DOCS values of less than 10^6), so they are exact.
            centre = np.bincount(terms[at], values[at], width).astype(np.int64) // len(rows)
            far = square[rows] - 2 * product(rows, centre) + int(centre @ centre)
            name = len(self.nodes)
            self.nodes.append((low, high, -1, -1))
            centres.append(centre)
            radius.append(_up(int(far.max())))
            if high - low > LEAF:
                a = rows[int(far.argmax())]
                to_a = square[rows] - 2 * product(rows, dense(a))
                b = rows[int(to_a.argmax())]
                to_b = square[rows] - 2 * product(rows, dense(b))
                order[low:high] = rows[np.argsort(to_a - to_b, kind="stable")]
                middle = (low + high) // 2
                left = grow(low, middle)
                self.nodes[name] = (low, high, left, grow(middle, high))
            return name

        grow(0, len(sizes))
        self.centres, self.radius = np.array(centres), np.array(radius)
        at, self.first = _entries(starts[order], sizes[order])
        self.terms, self.values, self.ids = terms[at], values[at], ids[order]
        self.ends = np.append(self.first[1:], len(self.terms))

    def search(self, own: np.ndarray, weight: np.ndarray, best: list[tuple[int, int]], top: int) -> int:
        """Put better rows of this tree into ``best``, a heap of ``(score, -id)`` of at most ``top``; returns leaves read.

        ``own``: the query's terms, ``weight``: theirs.
        """
        bound = self.centres[:, own] @ weight + _up(int(weight @ weight)) * self.radius
        dense = np.zeros(self.width, np.int64)
        dense[own] = weight
        queue, read = [(-int(bound[0]), 0)], 0
        while queue:
            most, name = heappop(queue)
            if len(best) == top and -most < best[0][0]:
                break
            low, high, left, right = self.nodes[name]
            if left >= 0:
                heappush(queue, (-int(bound[left]), left))
                heappush(queue, (-int(bound[right]), right))
                continue
            read += 1
            first, last = self.first[low], self.ends[high - 1]
            scores = np.add.reduceat(dense[self.terms[first:last]] * self.values[first:last], self.first[low:high] - first)
            least = best[0][0] if len(best) == top else 1
            for i in np.flatnonzero(scores >= least).tolist():
                found = (int(scores[i]), -int(self.ids[low + i]))
                if len(best) < top:
                    heappush(best, found)
                elif found > best[0]:
                    heappop(best)
                    heappush(best, found)
        return read


def _entries(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some rows, one after another, and where each row's begin there."""
    first = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(first - starts, sizes), first


def _search(queries: list[tuple[np.ndarray, np.ndarray]], width: int, docs: int, terms: int, top: int):
    """The function from rows of :func:`counted` to ``query, doc_id, score``, at most ``top`` of each query."""
    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        held: list[tuple] = []
        n = 0

        def tree() -> Tree:
            joined = [np.concatenate(parts) for parts in zip(*held, strict=True)]
            held.clear()
            return Tree(*joined, width)

        for batch in batches:
            for low in range(0, batch.num_rows, DOCS):
                part = batch.slice(low, DOCS)
                own = part.column("terms").flatten().to_numpy()
                times = part.column("times").flatten().to_numpy()
                sizes = np.diff(part.column("terms").offsets.to_numpy()).astype(np.int64)
                length = 10 + 90 * part.column("n").to_numpy() * docs // terms
                values = 1_000_000_000 * times // (1000 * times + 8 * np.repeat(length, sizes))
                ids = part.column("doc_id").fill_null(LAST).to_numpy()
                some = sizes > 0
                if some.any():
                    held.append((own, values, sizes[some], ids[some]))
                    n += int(some.sum())
                if n >= DOCS:
                    yield tree()
                    n = 0
        if held:
            yield tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for tree in trees(batches):
            for heap, (own, weight) in zip(best, queries, strict=True):
                tree.search(own, weight, heap, top)
        rows = [(q, None if -d == LAST else -d, s) for q, heap in enumerate(best) for s, d in heap]
        if rows:
            query, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                names=["query", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of every query, highest first."""
    spark, out = docs.sparkSession, None
    for block in query_blocks(queries, block_terms):
        vocabulary: dict[bytes, int] = {}
        numbers = [[vocabulary.setdefault(t, len(vocabulary)) for t in terms] for _, terms in block]
        vectors = written(counted(docs, vocabulary), "vectors")
        weight, n_docs, n_terms = weights(vectors, len(vocabulary))
        own = [(np.array(terms), weight[terms]) for terms in numbers]
        found = vectors.mapInArrow(
            _search(own, len(vocabulary), n_docs, n_terms, top), "query int, doc_id bigint, score bigint")
        items = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "query int, item_id bigint")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        part = written(best.join(F.broadcast(items), "query").select(  # one row for each query of the block
            "item_id", "rank", "doc_id", "score"), "ranked")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out
