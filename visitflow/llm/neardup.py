"""Near-duplicate documents by consistent weighted sampling of TF-IDF shingles.

* Shingles are ``SHINGLE`` consecutive words (lower case, letters and digits; a shorter text is one shingle). A shingle
  weighs its count times ``ln(1 + 1 / rate)``, ``rate`` being the share of documents that hold it, at least ``RAREST``:
  what stands in more than a quarter of the documents weighs less, while a large group of near copies, which has its
  shingles in common, too, keeps its similarity. The shares come from a count-min sketch over all documents: its size is fixed and its error is a share of the number
  of documents, so that weights behave alike at every size, and it is small enough to broadcast.
* Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each document; two documents share a sample
  with a probability equal to their weighted Jaccard similarity, and a band of ``ROWS`` samples is a bucket. At a
  similarity of 0.8 a pair misses all buckets with probability 8e-4.
* In a bucket, every document is first compared with the bucket's lowest one: a group of near copies takes one comparison
  for each. Where documents of a bucket are still of several classes, all those outside its largest class are compared
  with all others that they are not yet connected with, in blocks of ``BLOCK_CHARS`` characters: every pair of a bucket is compared or already connected.
  Nothing is capped, only links leave a block, and no task holds more than two blocks. Comparisons compute the weighted
  Jaccard similarity of whole texts; ``SIMILAR`` or more makes a link. Classes are the connected documents.

Documents of the same words are one node from the start. Null texts and texts without words are alike with nothing: each
is a class of its own. Rows equal in id and text are one document. The class is named by its lowest doc_id (nulls
first).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.shared import Cache, row_key, text_slices, travels, written

travels(__name__)

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 10, 3
RAREST = 0.25
DEPTH, WIDTH, BLOCK = 2, 1 << 18, 1 << 12
BLOCK_CHARS = 1_500_000  # of text that a task compares with as much

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_U = np.uint64
_ELEMENTS = 1 << 16  # shingles sampled at once: the arrays stay in a processor's cache


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def word_hashes() -> Cache:
    return Cache(lambda word: int.from_bytes(blake2b(word, digest_size=8).digest(), "little"))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_LETTERS).split() if text else []


def shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of a text, ascending, and how often each occurs."""
    if not len(hashes):
        return np.empty(0, _U), np.empty(0, np.int64)
    size = min(SHINGLE, len(hashes))
    out = np.full(len(hashes) - size + 1, size, _U)
    for i in range(size):
        out = out * _U(0x9E3779B97F4A7C15) + hashes[i:len(hashes) - size + 1 + i]
        out ^= out >> _U(29)
    return np.unique(_mixed(out), return_counts=True)


def _slots(elements: np.ndarray) -> list[np.ndarray]:
    """The place of each element in each row of the sketch."""
    return [((elements >> _U(18 * d)) & _U(WIDTH - 1)).astype(np.int64) for d in range(DEPTH)]


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What one task has counted, in blocks of the sketch; block -1 holds the number of documents."""
    counts, texts, number = np.zeros((DEPTH, WIDTH), np.int64), 0, word_hashes()
    for rows in batches:
        values = rows["text"].tolist()
        for low, high in text_slices(values):
            found = [np.empty(0, _U)]
            for text in values[low:high]:
                words = words_of(text)
                if words:
                    texts += 1
                    found.append(shingles(np.fromiter(map(number.__getitem__, words), _U, len(words)))[0])
            for row, slots in zip(counts, _slots(np.concatenate(found)), strict=True):
                row += np.bincount(slots, minlength=WIDTH)
    blocks = counts.reshape(-1, BLOCK)
    full = np.flatnonzero(blocks.any(axis=1))
    yield pd.DataFrame({"block": np.append(full, -1), "counts": [
        *(blocks[i].astype("<i8").tobytes() for i in full), np.array([texts], "<i8").tobytes()
    ]})


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[int, np.ndarray] = {}
    for rows in batches:
        for block, counts in zip(rows["block"], rows["counts"], strict=True):
            own = np.frombuffer(counts, "<i8")
            totals[block] = totals[block] + own if block in totals else own
    yield pd.DataFrame({"block": list(totals), "counts": [c.tobytes() for c in totals.values()]})


def sketch(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Count-min sketch of the documents' shingles, and the number of documents with words: 4 MB at every size."""
    schema = "block int, counts binary"
    parts = texts.select("text").mapInPandas(_sketched, schema)
    blocks = DEPTH * WIDTH // BLOCK + 1
    rows = parts.repartition(blocks, "block").mapInPandas(_summed, schema).collect()
    counts, total = np.zeros((DEPTH * WIDTH // BLOCK, BLOCK), np.int64), 0
    for row in rows:
        if row["block"] < 0:
            total += int(np.frombuffer(row["counts"], "<i8")[0])
        else:
            counts[row["block"]] += np.frombuffer(row["counts"], "<i8")
    return counts.reshape(DEPTH, WIDTH), total


class Weights:
    """Weight of every shingle, from a sketch."""

    def __init__(self, counts: np.ndarray, total: int) -> None:
        rate = np.clip(counts / max(total, 1), RAREST, 1.0)
        self.idf = np.log1p(1.0 / rate).astype(np.float32)

    def __call__(self, elements: np.ndarray, times: np.ndarray) -> np.ndarray:
        return np.max([row[s] for row, s in zip(self.idf, _slots(elements), strict=True)], axis=0) * times


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2."""
    x = np.geomspace(1e-4, 40, 200_000)
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x)


class Sampler:
    """Improved consistent weighted sampling: the random numbers of an element are tables read at bits of its hash."""

    def __init__(self) -> None:
        gamma = _gamma_quantiles()
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.beta = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)

    def bands(self, elements: np.ndarray, log_weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bucket numbers, a row for each document. ``elements`` of the documents follow one another; none is empty."""
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        owner = np.repeat(np.arange(len(lengths)), lengths)
        keys = np.empty((len(lengths), BANDS), _U)
        low = _U(0xFFFF)
        for band in range(BANDS):
            key = np.full(len(lengths), band + 1, _U)
            for row in range(ROWS):
                seed = _U((band * ROWS + row + 1) * 0xA0761D6478BD642F % (1 << 64))
                x = (elements ^ seed) * _U(0xE7037ED1A0B428DB)
                x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
                x ^= x >> _U(32)
                r, beta = self.r[x & low], self.beta[(x >> _U(32)) & low]
                step = np.floor(log_weight / r + beta)
                rank = self.log_c[(x >> _U(16)) & low] - r * (step - beta + np.float32(1))
                least = np.minimum.reduceat(rank, starts)
                at = np.flatnonzero(rank == least[owner])
                at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]
                chosen = elements[at] + step[at].astype(np.int64).astype(_U) * _U(0x9E3779B97F4A7C15)
                key = _mixed(key * _U(0xE7037ED1A0B428DB) + chosen)
            keys[:, band] = key
        return keys


def _groups(lengths: list[int]) -> Iterator[tuple[int, int]]:
    low = total = 0
    for i, n in enumerate(lengths):
        if total + n > _ELEMENTS and i > low:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(lengths):
        yield low, len(lengths)


def signatures(texts: DataFrame, counts: np.ndarray, total: int) -> DataFrame:
    """``key``, ``doc_id``, ``node`` (digest of the words) and ``bands`` of every row with words."""
    shipped = texts.sparkSession.sparkContext.broadcast((counts, total))

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, sampler, number = Weights(*shipped.value), Sampler(), word_hashes()
        for rows in batches:
            values = rows["text"].tolist()
            for low, high in text_slices(values):
                place, nodes, sets = [], [], []
                for i in range(low, high):
                    words = words_of(values[i])
                    if words:
                        hashes = np.fromiter(map(number.__getitem__, words), _U, len(words))
                        place.append(i)
                        nodes.append(blake2b(hashes.tobytes(), digest_size=16).digest())
                        sets.append(shingles(hashes))
                if not place:
                    continue
                lengths = [len(u) for u, _ in sets]
                bands = []
                for a, b in _groups(lengths):
                    elements = np.concatenate([u for u, _ in sets[a:b]])
                    weight = weights(elements, np.concatenate([n for _, n in sets[a:b]]))
                    keys = sampler.bands(elements, np.log(weight).astype(np.float32), np.array(lengths[a:b]))
                    bands.extend(keys.astype(np.int64))
                yield pd.DataFrame({
                    "key": rows["key"].iloc[place].to_numpy(), "doc_id": rows["doc_id"].iloc[place].to_numpy(),
                    "node": nodes, "bands": bands,
                }).astype({"doc_id": "Int64"})

    return texts.mapInPandas(signed, "key binary, doc_id bigint, node binary, bands array<bigint>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two pairs of ascending different elements and their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum() + b[1].sum()) - shared
    return shared / whole if whole > 0 else 0.0


def _vectors(weights: Weights):
    """The function from a text to its shingles and weights."""
    number = word_hashes()

    def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
        words = words_of(text)
        elements, times = shingles(np.fromiter(map(number.__getitem__, words), _U, len(words)))
        return elements, weights(elements, times)

    return vector


def _with_lowest(members: DataFrame, texts: DataFrame, counts: np.ndarray, total: int, similar: float) -> DataFrame:
    """Links ``a``, ``b`` between the lowest document of each bucket and the others. ``texts``: ``node, text``."""
    shipped = members.sparkSession.sparkContext.broadcast((counts, total))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vector, name, own = _vectors(Weights(*shipped.value)), None, None
        for rows in batches:
            alike = []
            for a, left, right in zip(rows["a"], rows["a_text"], rows["b_text"], strict=True):
                if a != name:
                    name, own = a, vector(left)
                alike.append(weighted_jaccard(own, vector(right)) >= similar)
            yield rows.loc[np.array(alike, bool), ["a", "b"]]

    lowest = members.groupBy("bucket").agg(F.min("node").alias("a"))
    pairs = members.join(lowest.hint("merge"), "bucket").where(F.col("node") != F.col("a")).select(
        "a", F.col("node").alias("b")).distinct()
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").mapInPandas(
        compared, "a binary, b binary")


class Block:
    """The vectors of several documents, as one array of places among their shingles and one of weights."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.names, self.place = np.unique(np.concatenate([u for u, _ in vectors]), return_inverse=True)
        self.weight = np.concatenate([w for _, w in vectors])
        self.lengths = np.array([len(u) for u, _ in vectors])
        self.whole = np.array([w.sum(dtype=np.float64) for _, w in vectors])
        self.row = np.zeros(len(self.names), self.weight.dtype)

    def similarity(self, vector: tuple[np.ndarray, np.ndarray], chosen: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity of a vector with the chosen documents (a mask)."""
        u, w = vector
        at = np.minimum(np.searchsorted(self.names, u), len(self.names) - 1)
        known = self.names[at] == u
        self.row[at[known]] = w[known]
        if chosen.all():
            place, weight = self.place, self.weight
        else:
            elements = np.repeat(chosen, self.lengths)
            place, weight = self.place[elements], self.weight[elements]
        ends = np.cumsum(self.lengths[chosen])
        shared = np.add.reduceat(
            np.minimum(self.row[place], weight), np.concatenate([[0], ends[:-1]]), dtype=np.float64)
        self.row[at[known]] = 0
        return shared / (self.whole[chosen] + w.sum(dtype=np.float64) - shared)


def links_across(
    left: list[tuple], right: list[tuple], bucket: int, similar: float, vector
) -> Iterator[tuple[bytes, bytes]]:
    """Links that connect documents of different classes. Documents: ``(node, class, bands, text)``.

    A pair is compared in the first bucket that its documents share, once, and only while they are not connected.
    """
    vectors = {}
    for node, _, _, text in [*left, *right]:
        if node not in vectors:
            vectors[node] = vector(text)
    block = Block([vectors[d[0]] for d in right])
    bands = np.array([d[2] for d in right])
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    top: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while top.get(x, x) != x:
            x = top[x]
        return x

    place = {d[0]: i for i, d in enumerate(right)}
    open_ = np.ones(len(right), bool)  # not yet compared with everything here
    roots = np.array([hash(d[1]) for d in right])
    for node, own, own_bands, _ in left:
        mine = root(own)
        chosen = open_ & (roots != hash(mine)) & ((bands == np.array(own_bands)).argmax(axis=1) == band)
        if chosen.any():
            at = np.flatnonzero(chosen)
            for j in at[block.similarity(vectors[node], chosen) >= similar]:
                other = root(right[j][1])
                if other != mine:
                    top[other] = mine
                    roots[roots == hash(other)] = hash(mine)
                    yield node, right[j][0]
        if node in place:
            open_[place[node]] = False


def _in_blocks(
    members: DataFrame, classes: DataFrame, texts: DataFrame, counts: np.ndarray, total: int, similar: float
) -> DataFrame:
    """Links between documents of different classes that share a bucket. ``texts``: ``node, text, bands``."""
    shipped = members.sparkSession.sparkContext.broadcast((counts, total))

    once: list = []  # what a task needs for all its groups

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        if not once:
            once.append(_vectors(Weights(*shipped.value)))
        columns = ["node", "class", "bands", "text"]
        strays = list(rows.loc[rows["stray"], columns].itertuples(index=False, name=None))
        others = list(rows.loc[~rows["stray"], columns].itertuples(index=False, name=None))
        bucket = int(rows["bucket"].iloc[0])
        found = list(links_across(strays, others, bucket, similar, once[0])) if strays and others else []
        return pd.DataFrame(found, columns=["a", "b"])

    own = members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    several = own.groupBy("bucket").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.mode("class").alias("main")
    ).where("low <> high").select("bucket", "main")
    rest = written(own.join(several.hint("merge"), "bucket").select(
        "bucket", "node", "class", "size", (F.col("class") != F.col("main")).alias("stray")), "strays")
    blocks = rest.groupBy("bucket").agg(*[
        (F.floor(F.sum(F.when(which, F.col("size")).otherwise(0)) / BLOCK_CHARS) + 1).cast("int").alias(name)
        for name, which in (("n_strays", F.col("stray")), ("n_all", F.lit(True)))
    ])
    dealt = rest.join(blocks.hint("merge"), "bucket")

    def part(n: str, seed: int):
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    # A stray meets every block of all, a document of a block every block of strays.
    columns = ("bucket", "node", "class")
    left = dealt.where("stray").select(*columns, part("n_strays", 1).alias("i"), every("n_all").alias("j"))
    right = dealt.select(*columns, part("n_all", 2).alias("j"), every("n_strays").alias("i"))
    both = left.withColumn("stray", F.lit(True)).unionByName(right.withColumn("stray", F.lit(False)))
    return both.join(texts.select("node", "text", "bands").hint("merge"), "node").groupBy("bucket", "i", "j").applyInPandas(
        compared, "a binary, b binary").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``class`` (the lowest connected node) of every node with a link ``(a, b)``.

    In each round a node takes the lowest class among its neighbours, and then the class of its class; every round is
    written to the shared folder.
    """
    edges = written(links.union(links.select("b", "a")).distinct(), "links")
    found = written(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")), "classes"
    )
    while True:
        near = edges.join(found.select(F.col("node").alias("b"), "class"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("class").alias("near"))
        lower = found.join(near, "node").select("node", F.least("class", "near").alias("class"), F.col("class").alias("old"))
        lower = written(lower, "classes")
        up = lower.select(F.col("node").alias("class"), F.col("class").alias("up"))
        after = written(
            lower.join(up, "class").select("node", F.least("class", "up").alias("class"), "old"), "classes"
        )
        found = after.select("node", "class")
        if after.where(F.col("class") != F.col("old")).isEmpty():
            return found


def classes_of(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``key``, ``doc_id``, ``class_id`` (lowest doc_id), ``first`` (this row names the class) and ``n_class`` (rows).

    ``key`` is :func:`shared.row_key` of ``doc_id`` and ``text``.
    """
    texts = docs.select(row_key("doc_id", "text").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts, total = sketch(texts)
    signed = written(signatures(texts, counts, total), "signatures")
    nodes = signed.groupBy("node").agg(F.min("key").alias("key"), F.first("bands").alias("bands"))
    members = nodes.select("node", "key", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = written(members.join(shared.hint("merge"), "bucket", "left_semi"), "members")
    wanted = nodes.join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    own = written(
        texts.select("key", "text").join(wanted.hint("merge"), "key").dropDuplicates(["key"]).select(
            "node", "text", "bands", F.length("text").cast("bigint").alias("size")),
        "texts",
    )
    members = written(members.select("bucket", "node").join(own.select("node", "size"), "node"), "members")
    links = written(_with_lowest(members, own, counts, total, similar), "links")
    classes = components(links)
    more = written(_in_blocks(members, classes, own, counts, total, similar), "links")
    if not more.isEmpty():
        classes = components(links.union(more))
    named = signed.select("key", "doc_id", "node")
    named = named.join(classes, "node", "left").withColumn("node", F.coalesce("class", "node")).drop("class")
    named = named.select("key", "doc_id", "node").unionByName(
        texts.join(signed.select("key"), "key", "left_anti").select("key", "doc_id", F.col("key").alias("node"))
    )
    named = written(named, "named")
    groups = named.groupBy("node").agg(
        F.min(F.struct("doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("n_class")
    )
    return named.join(groups, "node").select(
        "key", "doc_id", F.col("first.doc_id").alias("class_id"), (F.col("first.key") == F.col("key")).alias("first"),
        "n_class",
    )


def one_of_each(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each class, all columns: the one that names it."""
    keep = written(classes_of(docs, similar).where("first").select("key").distinct(), "kept")
    rows = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("key"))
    return rows.join(keep, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
