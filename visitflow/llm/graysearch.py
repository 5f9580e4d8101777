"""SimHash near-duplicates by a hierarchical index in Gray order.

* A document's fingerprint is the bitwise majority of the XXH64 hashes of its ``SHINGLE``-word shingles, repeats
  included. Documents are linked at ``DISTANCE`` or fewer differing bits; equal fingerprints are one node from the start.
* Two linked fingerprints agree in all bits of at least one of ``DISTANCE + 1`` bands. For each band, fingerprints are
  turned so that the band's bits lead, and sorted by Gray rank: neighbours in that order differ in few bits, and those
  that agree in the band stand together. The order is dealt to partitions by ranges, so a band value that holds a third
  of all fingerprints is cut into as many pieces as needed, of at most ``PIECE`` fingerprints each.
* Over a piece, ``FAN`` neighbours make a node, ``FAN`` nodes the next one, up to the piece's root. A node holds the bits
  that all below it share and that the node above does not hold yet. A search goes down from the root and adds up the
  differences with these shared bits; once they exceed ``DISTANCE``, the whole group below is left out. A group whose
  fingerprints are all connected with the searched one already is left out as well, so that a large group of near copies
  costs a search for each, not a comparison for each pair.
* Band values of several pieces are searched across pieces in a second step: fingerprints outside the band value's
  largest class look into those of its other pieces whose root's shared bits they match.

Tasks return the links of a spanning tree of what they connected, never all pairs. Classes are the connected nodes.

Null and empty texts and texts without words have fingerprint zero, which is linked like any other. Rows repeated in id
and text are returned each; a null id never names a class unless no other does. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.llm.neardup import components
from visitflow.llm.shared import travels, written

travels(__name__)

SHINGLE, SEED, DISTANCE = 4, 42, 4
PIECE = 4096  # fingerprints of one row of the index
FAN = 8
WIDE = 1 << 15  # comparisons with nodes that a search goes on with at once
FOREST = 1 << 16  # fingerprints whose pieces are searched together
LINKS = 64  # links from one node of a spanning tree to the next members of its class
AT_ONCE = 1 << 16  # hashes whose bits are counted at once

_U = np.uint64
_ONE = _U(1)


# --- fingerprints -------------------------------------------------------------------------------------------------

def fingerprint(text: bytes | None) -> int:
    """Bits that are set in over half of the hashes of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    ones, digest, join = np.zeros(64, np.int64), xxhash.xxh64_intdigest, b" ".join
    for low in range(0, n, AT_ONCE):
        high = min(low + AT_ONCE, n)
        hashes = np.fromiter((digest(join(words[i:i + size]), SEED) for i in range(low, high)), _U, high - low)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((_ONE << np.flatnonzero(2 * ones > n).astype(_U)).sum(dtype=_U))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (64 bits as a signed number) of every row."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("bytes")
            found = np.fromiter((fingerprint(texts[i].as_py()) for i in range(len(texts))), _U, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("bytes"))
    return rows.mapInArrow(signed, "doc_id bigint, fingerprint bigint")


# --- Gray order ---------------------------------------------------------------------------------------------------

def bands(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """First bit and width of each of ``distance + 1`` bands."""
    edges = [64 * i // (distance + 1) for i in range(distance + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def turned(x: np.ndarray, left: int) -> np.ndarray:
    left %= 64
    return (x << _U(left)) | (x >> _U(64 - left)) if left else x


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> _U(shift))
    return x


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> _ONE)


def index_of(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The index: rows ``band, top`` (the band's bits), ``low`` (first Gray rank), ``n``, ``ones`` and ``mask`` (bits that
    all share, turned), ``ranks``. ``nodes``: distinct ``fingerprint``.
    """
    layout = bands(distance)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fingerprint").to_numpy().view(_U)
            ranks = [gray_rank(turned(x, 64 - first - width)) for first, width in layout]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(layout), dtype=np.int32), len(x))),
                pa.array(np.concatenate(ranks).view(np.int64)),
            ], names=["band", "rank"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, rank = batch.column("band").to_numpy(), batch.column("rank").to_numpy().view(_U)
            width = np.array([w for _, w in layout])[band]
            top = rank >> (64 - width).astype(_U)
            new = np.ones(len(rank), bool)
            new[1:] = (band[1:] != band[:-1]) | (top[1:] != top[:-1])
            starts = np.flatnonzero(new)
            starts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(
                starts, np.append(starts[1:], len(rank)), strict=True)]) if len(rank) else starts
            if not len(starts):
                continue
            code = gray_code(rank)
            ones, zeros = np.bitwise_and.reduceat(code, starts), np.bitwise_and.reduceat(~code, starts)
            ends = np.append(starts[1:], len(rank))
            yield pa.RecordBatch.from_arrays([
                pa.array(band[starts]), pa.array(top[starts].view(np.int64)), pa.array(rank[starts].view(np.int64)),
                pa.array((ends - starts).astype(np.int32)), pa.array(ones.view(np.int64)),
                pa.array((ones | zeros).view(np.int64)),
                pa.array([rank[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
            ], names=["band", "top", "low", "n", "ones", "mask", "ranks"])

    ranks = nodes.select("fingerprint").mapInArrow(ranked, "band int, rank bigint")
    ordered = ranks.repartitionByRange("band", "rank").sortWithinPartitions("band", "rank")
    return ordered.mapInArrow(
        cut, "band int, top bigint, low bigint, n int, ones bigint, mask bigint, ranks binary")


# --- search -------------------------------------------------------------------------------------------------------

class Classes:
    """Connected members: ``of`` is the lowest member connected with each."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while True:
            left, right = of[a], of[b]
            apart = left != right
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(of, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
            while (up := of[of]).tobytes() != of.tobytes():
                of[:] = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning tree of every class: members in order, ``LINKS`` below each."""
        order = np.argsort(self.of, kind="stable")
        own = self.of[order]
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        place = np.arange(len(own)) - first
        later = place > 0
        return order[(first + (place - 1) // LINKS)[later]], order[later]


class Forest:
    """Trees over pieces of turned fingerprints in Gray order; ``starts``: the first member of each piece."""

    def __init__(self, code: np.ndarray, starts: np.ndarray) -> None:
        # Of every level: shared one bits, shared bits, first member, first child. Level 0 are the members.
        ends = np.append(starts[1:], len(code))
        ones, zeros, piece = code, ~code, np.repeat(np.arange(len(starts)), ends - starts)
        first = np.arange(len(code))
        self.levels = [(ones, ~_U(0) + np.zeros(len(code), _U), first, None)]
        while len(piece) > len(starts):
            new = np.ones(len(piece), bool)
            new[1:] = piece[1:] != piece[:-1]
            of_piece = np.flatnonzero(new)
            new |= (np.arange(len(piece)) - of_piece[np.cumsum(new) - 1]) % FAN == 0
            child = np.flatnonzero(new)
            ones, zeros = np.bitwise_and.reduceat(ones, child), np.bitwise_and.reduceat(zeros, child)
            first, piece = first[child], piece[child]
            self.levels.append((ones, ones | zeros, first, child))
        self.n = len(code)
        # What a node shares beyond the node above.
        self.rest = []
        for level, (_, mask, _, _) in enumerate(self.levels):
            if level + 1 < len(self.levels):
                _, above, _, child = self.levels[level + 1]
                size = np.diff(np.append(child, len(mask)))
                mask = mask & ~np.repeat(above, size)
            self.rest.append(mask)

    def ranges(self, of: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lowest and highest class below every node."""
        out = []
        for _, _, first, _ in self.levels:
            out.append((np.minimum.reduceat(of, first), np.maximum.reduceat(of, first)) if len(first) else (of, of))
        return out

    def connect(self, queries: np.ndarray, roots: np.ndarray, member: np.ndarray, classes: Classes, distance: int,
                later: bool) -> None:
        """Unite every query with all members within the distance in the piece of its root.

        ``member``: the number of each query in ``classes``, where the forest's members come first. ``later``: queries
        are members, and look for those after them only.
        """
        top = len(self.levels) - 1
        ranges = self.ranges(classes.of[:self.n])
        stack = [(top, np.arange(len(queries)), roots, np.zeros(len(queries), np.int64))]
        while stack:
            level, query, node, sums = stack.pop()
            if len(query) > WIDE:  # the rest waits, so that memory stays bounded
                stack.append((level, query[WIDE:], node[WIDE:], sums[WIDE:]))
                query, node, sums = query[:WIDE], node[:WIDE], sums[:WIDE]
            ones, _, first, child = self.levels[level]
            own = classes.of[member[query]]
            low, high = ranges[level]
            open_ = (low[node] != own) | (high[node] != own)
            if later:
                last = np.append(first[1:], self.n) - 1
                open_ &= last[node] > member[query]
            query, node, sums = query[open_], node[open_], sums[open_]
            differ = np.bitwise_count((queries[query] ^ ones[node]) & self.rest[level][node])
            sums = sums + differ
            near = sums <= distance
            query, node, sums = query[near], node[near], sums[near]
            if not len(query):
                continue
            if level == 0:
                classes.unite(member[query], node)
                ranges = self.ranges(classes.of[:self.n])
                continue
            size = np.diff(np.append(child, len(self.levels[level - 1][0])))[node]
            offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            stack.append((level - 1, np.repeat(query, size), np.repeat(child[node], size) + offset, np.repeat(sums, size)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of index rows with the turned fingerprints of all, and where each row's start."""
    for batch in batches:
        sizes, low = batch.column("n").to_numpy(), 0
        while low < batch.num_rows:
            high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), FOREST, side="right")))
            part = batch.slice(low, high - low)
            ranks = np.frombuffer(b"".join(part.column("ranks").to_pylist()), _U)
            yield part, gray_code(ranks), np.concatenate([[0], np.cumsum(sizes[low:high])[:-1]]).astype(np.int64)
            low = high


def _back(code: np.ndarray, band: np.ndarray, layout: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints as they were before turning."""
    left = np.array([(first + width) % 64 for first, width in layout], _U)[band]
    return (code << left) | np.where(left > 0, code >> ((_U(64) - left) % _U(64)), _U(0))


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links_within(index: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` (fingerprints) that connect all within the distance in one piece of the index."""
    layout = bands(distance)

    def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, code, starts in _pieces(batches):
            forest, classes = Forest(code, starts), Classes(len(code))
            sizes = np.diff(np.append(starts, len(code)))
            piece = np.repeat(np.arange(len(starts)), sizes)
            forest.connect(code, piece, np.arange(len(code)), classes, distance, later=True)
            back = _back(code, np.repeat(part.column("band").to_numpy(), sizes), layout)
            a, b = classes.links()
            yield _links(back[a], back[b])

    return index.select("band", "n", "ranks").mapInArrow(connected, "a bigint, b bigint").distinct()


def links_between(index: DataFrame, classes: DataFrame, distance: int = DISTANCE) -> DataFrame | None:
    """Links between pieces of one band value, ``None`` if each is one piece. ``classes``: ``node, class``."""
    layout = bands(distance)
    several = index.groupBy("band", "top").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1").drop("pieces")
    pieces = written(index.join(several, ["band", "top"], "left_semi"), "pieces")
    if pieces.isEmpty():
        return None

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, code, starts in _pieces(batches):
            sizes = np.diff(np.append(starts, len(code)))
            own = [np.repeat(part.column(c).to_numpy(), sizes) for c in ("band", "top", "low")]
            yield pa.RecordBatch.from_arrays([
                *map(pa.array, own), pa.array(code.view(np.int64)), pa.array(_back(code, own[0], layout).view(np.int64))
            ], names=["band", "top", "low", "code", "node"])

    members = pieces.select("band", "top", "low", "n", "ranks").mapInArrow(
        listed, "band int, top bigint, low bigint, code bigint, node bigint")
    members = written(members.join(classes.hint("merge"), "node", "left").select(
        "band", "top", "low", "code", F.coalesce("class", "node").alias("class")), "members")
    sizes = members.groupBy("band", "top", "class").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band", "top").agg(F.max_by("class", F.struct("n", "class")).alias("main"))
    strays = members.join(main, ["band", "top"]).where("class <> main").select("band", "top", "low", "code")

    def differences(code: Column) -> Column:
        return F.bit_count(code.bitwiseXOR(F.col("ones")).bitwiseAND(F.col("mask")))

    roots = pieces.select("band", "top", F.col("low").alias("other"), "ones", "mask")
    wanted = written(strays.join(roots, ["band", "top"]).where(
        (F.col("low") != F.col("other")) & (differences(F.col("code")) <= distance)
    ).select("band", F.col("other").alias("low"), "code"), "strays")
    rows = wanted.groupBy("band", "low").agg((F.floor(F.count(F.lit(1)) / PIECE) + 1).alias("parts"))
    dealt = wanted.join(rows, ["band", "low"]).groupBy(
        "band", "low", F.pmod(F.xxhash64("code"), "parts").alias("part")).agg(F.collect_list("code").alias("codes"))

    def connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                for part, code, starts in _pieces([row]):
                    seeks = row.column("codes").flatten().to_numpy().view(_U)
                    found, forest = Classes(len(code) + len(seeks)), Forest(code, starts)
                    member = len(code) + np.arange(len(seeks))
                    forest.connect(seeks, np.zeros(len(seeks), np.int64), member, found, distance, later=False)
                    both = np.concatenate([code, seeks])
                    back = _back(both, np.full(len(both), part.column("band")[0].as_py()), layout)
                    a, b = found.links()
                    yield _links(back[a], back[b])

    return dealt.join(pieces.select("band", "low", "n", "ranks").hint("merge"), ["band", "low"]).select(
        "band", "n", "ranks", "codes").mapInArrow(connected, "a bigint, b bigint").distinct()


def linked(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (signed), ``component_id`` (lowest doc_id reachable) and ``n_nodes`` (fingerprints of
    the class) of every row.
    """
    signed = written(fingerprints(docs), "fingerprints")
    nodes = written(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("lowest")), "nodes")
    index = written(index_of(nodes, distance), "index")
    links = written(links_within(index, distance), "links")
    classes = components(links)
    more = links_between(index, classes, distance)
    if more is not None:
        more = written(more, "links")
        if not more.isEmpty():
            classes = components(links.union(more))
    own = nodes.join(classes.withColumnRenamed("node", "fingerprint").hint("merge"), "fingerprint", "left").select(
        "fingerprint", "lowest", F.coalesce("class", "fingerprint").alias("class"))
    named = own.groupBy("class").agg(F.min("lowest").alias("component_id"), F.count(F.lit(1)).alias("n_nodes"))
    of_node = written(own.join(named.hint("merge"), "class").select("fingerprint", "component_id", "n_nodes"), "components")
    return signed.join(of_node.hint("merge"), "fingerprint").select("doc_id", "fingerprint", "component_id", "n_nodes")
