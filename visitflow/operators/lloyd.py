"""K-Means from fixed starts, the same on every cluster and in SQL.

MLlib's fit adds floating-point numbers in whatever order tasks end, and draws its starts. Here features are whole numbers
(``UNIT`` to one deviation), sums are exact, and centres are whole numbers again, so that a fit depends on the rows alone.

Starts are visits of lowest hash: start ``s`` takes ranks ``s * k`` to ``s * k + k - 1``. All starts take their Lloyd steps
together, one pass over the distinct points and their counts for each round; a round sends back one row for each centre.
Equal points are one row, so the size of a round is that of the distinct feature values, not of the visits. Distances to
all centres are taken a batch of points at a time (Arrow and numpy), in the order of columns that ``assign`` adds them in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.operators.sampling import hash_key
from visitflow.sources.scratch import written

UNIT = 1_000_000
ROUNDS = 300  # at most
SLICE = 8_192  # points whose distances are taken at once

Centres = list[tuple[int, ...]]


@dataclass
class Fit:
    """The centres of the best start, the sum of squared distances to them (in units), its start, and the rounds taken."""

    centres: Centres
    inertia: int
    start: int
    rounds: int


def whole(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns in whole units; null (a column without values) is 0."""
    return df.withColumns({c: F.coalesce(F.round(F.col(c) * UNIT), F.lit(0.0)).cast("bigint") for c in columns})


def _distance(columns: Sequence[str], centre: Sequence[str]) -> str:
    """SQL of the squared distance to a centre, whose coordinates are SQL too; written out, so that it is compiled."""
    apart = [f"(CAST(`{c}` AS DOUBLE) - {x})" for c, x in zip(columns, centre, strict=True)]
    return " + ".join(f"{a} * {a}" for a in apart)


def _array(values: Iterable[str]) -> str:
    return f"array({', '.join(values)})"


def _literals(centre: Sequence[int]) -> list[str]:
    return [f"{x}D" for x in centre]


def _sums(columns: Sequence[str], centres: list[Centres]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of points and counts: the points nearest to each centre of each start, their number and exact sums.

    One row for each start and centre of a task. A function of this call, so it travels to the workers by value.
    """
    names, k, most, none = list(columns), len(centres[0]), SLICE, [0] * (len(columns) + 1)

    def added(best: np.ndarray, values: np.ndarray) -> list[int]:
        # Halves of 32 bits: their sums over a slice are whole numbers below 2**53, so doubles hold them.
        high, low = (np.bincount(best, half.astype(np.float64), k) for half in (values >> 32, values & 0xFFFFFFFF))
        return [(int(a) << 32) + int(b) for a, b in zip(high, low, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[none] * k for _ in centres]
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                n, *xs = (batch.column(c).slice(at, most).to_numpy(zero_copy_only=False) for c in ("n", *names))
                doubles = [x.astype(np.float64) for x in xs]
                if any((np.abs(x) * n >= 2.0**63).any() for x in doubles):
                    raise OverflowError("a feature value times its count is beyond 64 bits")
                values = [n, *(x * n for x in xs)]
                for s, own in enumerate(centres):
                    distance = np.zeros((k, len(n)))
                    for i, centre in enumerate(own):
                        for x, c in zip(doubles, centre, strict=True):
                            d = x - float(c)
                            distance[i] += d * d
                    best = distance.argmin(axis=0)  # the first of equals
                    more = zip(*(added(best, v) for v in values), strict=True)
                    total[s] = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(total[s], more, strict=True)]
        rows = [(s, i, *row) for s, own in enumerate(total) for i, row in enumerate(own) if row[0]]
        if rows:
            s, cluster, n, *sums = zip(*rows, strict=True)
            exact = [pa.array([Decimal(v) for v in x], pa.decimal128(38, 0)) for x in sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s, pa.int32()), pa.array(cluster, pa.int32()), pa.array(n, pa.int64()), *exact],
                ["s", "cluster", "n", *names])

    return run


def first_centres(points: DataFrame, columns: Sequence[str], k: int, starts: int, seed: int) -> list[Centres]:
    """``k`` centres for each start, by hash rank; fewer rows than that make fewer starts or centres."""
    order = [hash_key(seed), *columns]
    rows = [tuple(r) for r in points.orderBy(*order).limit(k * starts).select(*columns).collect()]
    return [rows[low:low + k] for low in range(0, len(rows), k) if low == 0 or len(rows) - low >= k]


def fit(
    points: DataFrame, columns: Sequence[str], k: int, starts: int, seed: int, shift: float, rounds: int = ROUNDS
) -> Fit:
    """The start of lowest inertia. ``points``: ``patient_id`` and whole columns.

    A start ends when its centres together move by less than ``shift`` squared deviations; an empty cluster stays.
    """
    centres = first_centres(points, columns, k, starts, seed)
    if not centres:
        return Fit([], 0, 0, 0)
    weighted = written(points.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")), "points").persist()
    open_, taken = list(range(len(centres))), 0
    schema = "s int, cluster int, n bigint, " + ", ".join(f"`{c}` decimal(38,0)" for c in columns)
    sums = [F.sum(c).alias(c) for c in ("n", *columns)]
    while open_ and taken < rounds:
        found = weighted.mapInArrow(_sums(columns, [centres[s] for s in open_]), schema)
        means = found.groupBy("s", "cluster").agg(*sums)
        after = {s: list(centres[s]) for s in open_}
        for row in means.collect():  # at most one row for each centre
            n = int(row["n"])
            after[open_[row["s"]]][row["cluster"]] = tuple((2 * int(row[c]) + n) // (2 * n) for c in columns)
        moved = {
            s: sum((a - b) ** 2 for x, y in zip(centres[s], after[s], strict=True) for a, b in zip(x, y, strict=True))
            for s in open_
        }
        for s in open_:
            centres[s] = after[s]
        open_ = [s for s in open_ if moved[s] >= shift * UNIT**2]
        taken += 1
    # A row for each point and start, so that one short distance is compiled for all starts.
    each = _array(f"named_struct('s', {s}, 'centres', {_array(map(_array, map(_literals, own)))})"
                  for s, own in enumerate(centres))
    k, d = len(centres[0]), len(columns)
    far = [_distance(columns, [f"centres[{i}][{j}]" for j in range(d)]) for i in range(k)]
    least = F.expr(f"array_min({_array(far)})").cast("decimal(38,0)")
    paired = weighted.select(*columns, "n", F.inline(F.expr(each)))
    costs = {r["s"]: int(r["cost"]) for r in paired.groupBy("s").agg(F.sum(least * F.col("n")).alias("cost")).collect()}
    weighted.unpersist()
    best = min(range(len(costs)), key=lambda i: (costs[i], i))
    return Fit(centres[best], costs[best], best, taken)


def assign(points: DataFrame, columns: Sequence[str], centres: Centres) -> DataFrame:
    """Add ``cluster``."""
    if not centres:
        return points.withColumn("cluster", F.lit(None).cast("int"))
    far = [f"named_struct('distance', {_distance(columns, _literals(c))}, 'cluster', {i})" for i, c in enumerate(centres)]
    return points.withColumn("cluster", F.expr(f"array_min({_array(far)})")["cluster"])  # the first of equals
