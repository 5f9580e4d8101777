"""Product codes of vectors: integer k-means per part, assigned over a trie of the distinct parts.

A vector becomes integers (``floor(SCALE * x)``) and is cut into ``PARTS`` consecutive parts. Each part position has a
codebook of ``ENTRIES`` entries that starts as the parts of the vectors of lowest id and is refined in ``ROUNDS`` rounds.

* The distinct parts and their counts are sorted by position and components, so that each partition holds one stretch of
  the lexicographic trie of all parts: its nodes are shared prefixes of components.
* The trie is walked depth-first. A node holds its prefix's squared distance to every entry, which all parts below start
  from; at a leaf, the least of them names the entry, and the part, weighted by its count, is added to the entry's sum.
  Subtrees of at most ``BLOCK`` leaves are walked as one array, level by level.
* A round leaves one row per position, entry and component: what the driver adds up has the size of the codebooks,
  however many vectors there are. Copies of a vector are one part with a count, so a hot vector costs one leaf.

All arithmetic is on 64-bit integers, so results do not depend on the order of rows.

Vectors that are null or hold null or non-finite components are dropped. Shorter vectors than the longest, and lengths
that ``PARTS`` does not divide, are filled up with zeros; components beyond ``MOST`` after scaling count as ``MOST``.
Repeated rows are coded one by one; of several vectors with one id, the codebook starts with the lowest, and a null id
comes last. With fewer ids than ``ENTRIES`` the codebook is that much smaller. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from visitflow.llm.shared import travels, written

travels(__name__)

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
MOST = 1 << 26
BLOCK = 512  # leaves of a subtree that is walked as one array
BATCH_NUMBERS = 1 << 20  # components that a task turns into an array at once


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers, rounded down; null if the vector or one of its components is null or not finite."""
    def whole(x: Column) -> Column:
        return F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int")

    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(vector, whole))


def assigned(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties: the first) and squared distance of every part; parts ascend, and all differ."""
    codes, distances = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    stack = [(0, len(parts), 0, np.zeros(len(entries), np.int64))] if len(parts) else []
    while stack:
        low, high, depth, above = stack.pop()
        if high - low <= BLOCK:
            _block(parts[low:high], depth, above, entries, codes[low:high], distances[low:high])
            continue
        column = parts[low:high, depth]
        edges = low + np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [high - low]])
        run = low  # neighbouring small children are walked together, from this node's distances
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            large = b - a > BLOCK
            if run < a and (large or b - run > BLOCK):
                stack.append((run, a, depth, above))
                run = a
            if large:
                stack.append((a, b, depth + 1, above + (parts[a, depth] - entries[:, depth]) ** 2))
                run = b
        if run < high:
            stack.append((run, high, depth, above))
    return codes, distances


def _block(parts, depth: int, above, entries, codes, distances) -> None:
    """A subtree level by level: one row of distances per prefix, made from the row of the prefix before."""
    sums, owner = above[None, :], np.zeros(len(parts), np.int64)
    for j in range(depth, parts.shape[1]):
        new = np.ones(len(parts), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (parts[1:, j] != parts[:-1, j])
        first = np.flatnonzero(new)
        sums = sums[owner[first]] + (parts[first, j, None] - entries[None, :, j]) ** 2
        owner = np.cumsum(new) - 1
    best = sums.argmin(axis=1)
    codes[:] = best[owner]
    distances[:] = sums[np.arange(len(best)), best][owner]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`assigned`, for parts in any order and with repeats: a trie of the distinct ones."""
    if not len(parts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    ascending = parts[order]
    new = np.ones(len(parts), bool)
    new[1:] = (ascending[1:] != ascending[:-1]).any(axis=1)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(new) - 1
    codes, distances = assigned(ascending[new], entries)
    return codes[place], distances[place]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, BATCH_NUMBERS // max(width, 1))
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _sums(books: np.ndarray):
    """The function from distinct parts and counts to one row of sums and count per position and entry used."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in _slices(batches, books.shape[2]):
            position = batch.column("position").to_numpy()
            parts, n = _matrix(batch.column("part"), books.shape[2]), batch.column("n").to_numpy()
            for p in np.unique(position):
                own = np.flatnonzero(position == p)
                codes, _ = assigned(parts[own], books[p])
                order = np.argsort(codes, kind="stable")
                used, starts = np.unique(codes[order], return_index=True)
                weight = n[own][order]
                totals[p, used] += np.add.reduceat(parts[own][order] * weight[:, None], starts, axis=0)
                counts[p, used] += np.add.reduceat(weight, starts)
        at = np.argwhere(counts > 0)
        yield pa.RecordBatch.from_arrays([
            pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[at[:, 0], at[:, 1]], pa.int64()),
            pa.array(totals[at[:, 0], at[:, 1]].tolist(), pa.list_(pa.int64())),
        ], names=["position", "entry", "n", "sums"])

    return run


def refined(parts: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round over the distinct parts; unused entries stay."""
    rows = parts.mapInArrow(_sums(books), "position int, entry int, n bigint, sums array<bigint>")
    counted = F.array_append(F.col("sums"), F.col("n"))  # the count is summed like a further component
    rows = rows.select("position", "entry", F.posexplode(counted).alias("component", "value"))
    after, counts = books.copy(), {}
    totals = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    for row in rows.groupBy("position", "entry", "component").agg(F.sum("value").alias("value")).collect():
        totals[row["position"], row["entry"], row["component"]] = row["value"]
    counts = totals[:, :, -1:]
    used = counts[:, :, 0] > 0
    after[used] = totals[used][:, :-1] // counts[used]
    return after


@dataclass
class Coded:
    """``rows``: each kept row without its vector as ``row``, its ``code`` (entry per part), ``error``; ``books``: the final codebooks."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all entries' components, by part, entry and place in the part."""
        return sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _starts(whole: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """Parts of the vectors of lowest id: ids first, then only their vectors; at most ``entries`` rows are fetched."""
    ids = whole.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries).collect()
    known = [row["id"] for row in ids if row["id"] is not None]
    wanted = F.col("id") <= F.lit(max(known)) if known else F.lit(False)
    if len(known) < len(ids):
        wanted = wanted | F.col("id").isNull()
    rows = whole.where(wanted).groupBy("id").agg(F.min("ints").alias("ints")).orderBy(F.asc_nulls_last("id")).collect()
    return np.array([row["ints"] for row in rows], np.int64).reshape(len(rows), parts, width).transpose(1, 0, 2).copy()


def coded(
    vectors: DataFrame, column: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> Coded:
    """Fit codebooks on all kept vectors and code them."""
    rest = [c for c in vectors.columns if c != column]
    rows = vectors.select(
        F.struct(*rest).alias("row"), F.col(key).cast("bigint").alias("id"), integers(F.col(column), scale).alias("ints"))
    rows = rows.where("ints IS NOT NULL")
    longest = rows.agg(F.max(F.size("ints"))).first()[0] or 0
    width = -(-longest // parts)
    filled = F.concat("ints", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("ints")))
    whole = written(rows.withColumn("ints", filled), "vectors")
    cut = F.array(*[F.slice("ints", F.lit(p * width + 1), F.lit(width)) for p in range(parts)])
    distinct = whole.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(
        F.count(F.lit(1)).alias("n"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = written(
        distinct.repartitionByRange(n, "position", "part").sortWithinPartitions("position", "part"), "parts")
    books = _starts(whole.select("id", "ints"), width, parts, entries)
    for _ in range(rounds):
        books = refined(distinct, books)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, books.shape[0] * books.shape[2]):
            ints = _matrix(batch.column("ints"), books.shape[0] * books.shape[2])
            codes, error = np.empty((len(ints), books.shape[0]), np.int32), np.zeros(len(ints), np.int64)
            for p in range(books.shape[0]):
                codes[:, p], far = nearest(ints[:, p * books.shape[2]:(p + 1) * books.shape[2]], books[p])
                error += far
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), pa.array(list(codes), pa.list_(pa.int32())), pa.array(error, pa.int64())
            ], names=["row", "code", "error"])

    out = whole.select("row", "ints")
    schema = StructType().add(out.schema["row"]).add("code", ArrayType(IntegerType())).add("error", LongType())
    return Coded(out.mapInArrow(final, schema), books)


def with_group_error(found: DataFrame, label: Column, name: str = "label_error") -> DataFrame:
    """Add the error summed over the rows of equal ``label`` (nulls are equal): sums meet the rows by a join.

    ``found`` is written first, so that it is computed once.
    """
    own = written(found, "coded").withColumn("_label", label)
    sums = own.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias(name))
    return own.join(sums, F.col("_label").eqNullSafe(F.col("_of"))).drop("_label", "_of")
