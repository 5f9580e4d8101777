"""Shards of nearly equal bytes from indivisible groups, by Karmarkar-Karp differencing.

Rows of equal texts are one group and stay together. A *partial partition* is a set of groups dealt to ``shards`` slots;
its spread is the largest slot's bytes less the smallest's. Differencing takes the two partial partitions of largest
spread and joins them in opposite order - the largest slot of one with the smallest of the other - until one is left.

Groups are dealt to parts by hash, and each part is differenced in one task. A group larger than what a part brings to a
shard on average could not be evened out there, so such groups - at most ``shards`` for each part - are dealt to shards
first, in the same way. What they bring to the shards takes part in the differencing of every part as one partial
partition, divided by the number of parts, so the parts' groups fill what the large ones leave. No task holds more than a
part's groups, and the driver sees ``shards`` numbers a level.

A group that is larger than a shard's fair share cannot be divided; it then makes the largest shard, and the rest stay
equal. Null and empty texts are one group. Repeated rows are counted each. ``slot`` numbers the rows of a shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitflow.llm.shared import travels, written

travels(__name__)

SHARDS = 40
PART = 4_096  # groups that one task differences
OVERHEAD = 16  # bytes of a row besides its text
BUCKETS = 1_024  # into which a shard is divided to number its rows


def differenced(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One partial partition from the rows of ``sums``, and for each row the final slot of each of its slots."""
    count, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    tops = {i: np.take_along_axis(sums[i], order[i], 0) for i in range(count)}  # sums of a node, largest first
    heap = [(-int(tops[i][0] - tops[i][-1]), i) for i in range(count)]
    heapq.heapify(heap)
    joins: list[tuple[int, int, np.ndarray]] = []  # of node count + j: two nodes; place of the first's and second's
    number = count
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = tops.pop(a) + tops.pop(b)[::-1]
        places = np.argsort(-both, kind="stable")
        where = np.empty(k, np.int16)
        where[places] = np.arange(k)
        joins.append((a, b, where))
        tops[number] = both[places]
        heapq.heappush(heap, (-int(both.max() - both.min()), number))
        number += 1
    root = heap[0][1]
    final = {root: np.arange(k)}  # final slot of a node's places
    for j in range(len(joins) - 1, -1, -1):
        a, b, where = joins[j]
        own = final.pop(count + j)[where]
        final[a], final[b] = own, own[::-1]
    slots = np.empty((count, k), np.int64)
    for i in range(count):
        slots[i, order[i]] = final[i]
    return tops[root], slots


def _dealer(shards: int, parts: int, base: np.ndarray):
    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("digest", kind="stable").reset_index(drop=True)
        part = int(rows["part"].iloc[0])
        sums = np.zeros((len(rows) + 1, shards), np.int64)
        sums[0] = base // parts + (part < base % parts)
        sums[1:, 0] = rows["size"]
        _, slots = differenced(sums)
        shard = np.empty(shards, np.int64)
        shard[slots[0]] = np.arange(shards)  # a slot is the shard whose large groups are in it
        return pd.DataFrame({"digest": rows["digest"], "size": rows["size"], "shard": shard[slots[1:, 0]]})

    return deal


def group_shards(groups: DataFrame, shards: int = SHARDS, part: int = PART) -> DataFrame:
    """``digest``, ``size`` and ``shard`` of every group. ``groups``: ``digest`` (once each) and ``size``."""
    groups = groups.select("digest", F.col("size").cast("bigint").alias("size"))
    seen = groups.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).first()
    parts = max(1, -(-seen["n"] // part))
    base, done = np.zeros(shards, np.int64), None
    if parts > 1:
        large = F.col("size") > int(seen["total"]) // (shards * parts)
        done = written(group_shards(groups.where(large), shards, part), "large-groups")
        for row in done.groupBy("shard").agg(F.sum("size").alias("size")).collect():
            base[row["shard"]] = row["size"]
        groups = groups.where(~large)
    dealt = groups.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("bigint"))
    placed = dealt.groupBy("part").applyInPandas(
        _dealer(shards, parts, base), "digest binary, size bigint, shard int")
    return placed if done is None else placed.unionByName(done)


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = written(docs.select(
        F.col("doc_id"), (F.octet_length(raw) + OVERHEAD).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("digest"),
    ).withColumn("id", F.monotonically_increasing_id()), "sizes")
    groups = written(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    placed = written(rows.join(group_shards(groups, shards).select("digest", "shard"), "digest").withColumn(
        "bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")), "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # One row for each shard and bucket, so the window sorts at most BUCKETS rows of a shard.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "bucket").orderBy("id")
    return placed.withColumn("n", F.row_number().over(within)).join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("n") - 1).cast("bigint").alias("slot"))
