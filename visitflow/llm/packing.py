"""Token sequences packed by best-fit decreasing, certified by lower bounds and repacked where the bounds leave a gap.

* A document is its token ids and an end mark. One longer than a sequence is cut into full sequences; what is left over
  comes first, as a shorter piece. Full pieces are sequences of their own; the others are packed.
* Pieces are dealt to groups by hash, and each group is packed by best-fit decreasing. Dual feasible functions give a
  lower bound of the sequences that a group's pieces need: with ``u`` of them for pieces of given lengths, no packing
  needs less. A group that reaches its bound is certified.
* Sequences with room of groups that are not certified, and the emptiest sequence of certified ones, go back: whole old
  sequences are dealt to fewer groups and packed again. A group keeps its old sequences unless the new ones are fewer.
  This goes on until the sequences with room fit one group or a round gains nothing.

Null texts are empty texts: a document of one end mark. Equal rows are packed each on its own.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.llm.shared import Cache, travels, written

travels(__name__)

CAPACITY = 1024
END = 2
GROUP = 8_192  # pieces that are packed together
# --- fixed value: the pre-tokenisation pattern of the vocabulary ---------------------------------------------------
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --- end of fixed values -------------------------------------------------------------------------------------------

_ROOM = re.compile(r"\s ")

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def added_tokens(vocabulary: str) -> dict[str, int]:
    """The tokens that are found in plain text before it is split, and their ids."""
    tokens = json.loads(Path(vocabulary).with_suffix(".json").read_text(encoding="utf-8"))["added_tokens"]
    odd = [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if odd:
        raise ValueError(f"added tokens that look at their surroundings are not supported: {odd}")
    return {t["content"]: t["id"] for t in tokens}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, with the merges that ``tokenizers`` applies.

    Added tokens, which the ``.json`` file beside the vocabulary names, are found in the text first and have ids of their
    own, as ``tokenizers`` has it with ``add_special_tokens=False``, too; what stands between them is encoded by itself.

    Texts are split before single spaces, where no token reaches across, and the ids of every such word are remembered.
    A text with white space before a space is encoded whole.
    """

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ids = lambda text: np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        self._first, self._next = Cache(self._ids), Cache(lambda word: self._ids(" " + word))
        self._added = {text: np.array([number], "<u4").tobytes() for text, number in added_tokens(vocabulary).items()}
        longest = sorted(self._added, key=len, reverse=True)
        self._split = re.compile(f"({'|'.join(map(re.escape, longest))})").split if longest else lambda text: [text]

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        between = self._split(text)
        if len(between) == 1:
            return self._ordinary(text)
        return b"".join(self._added[part] if n % 2 else self._ordinary(part) for n, part in enumerate(between))

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if _ROOM.search(text) or text[0].isspace() and len(text) == 1:
            return self._ids(text)
        first, *rest = text.split(" ")
        return self._first[first] + b"".join(map(self._next.__getitem__, rest))


def cuts(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document."""
    first = tokens % capacity or min(tokens, capacity)
    return [(0, first), *((at, capacity) for at in range(first, tokens, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids`` (bytes) of all documents."""
    mark = np.array([end], "<u4").tobytes()

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(vocabulary)
        for rows in batches:
            found, size = [], 0
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                ids = encode(text) + mark
                for n, (at, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    found.append((doc, n, at, length, ids[4 * at:4 * (at + length)]))
                    size += 4 * length
                if size > 8_000_000:
                    yield _piece_rows(found)
                    found, size = [], 0
            yield _piece_rows(found)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(encoded, PIECE)


def _piece_rows(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["doc_id", "piece", "start", "length", "ids"]).astype({"doc_id": "Int64"})


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Sequences that the pieces need at least: the best of three families of dual feasible functions.

    Each function gives a length a share of a sequence such that pieces that fit together have shares of 1 or less in
    sum: the length itself; with a threshold, long pieces count whole and short ones not at all; and rounded shares of
    a k-th of a sequence.
    """
    count = np.bincount(lengths, minlength=capacity + 1)[:capacity + 1]
    size = np.arange(capacity + 1)
    total = int((count * size).sum())
    best = -(-total // capacity)
    number, volume = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(capacity // 2 + 1)  # threshold: longer than capacity - t is whole, shorter than t nothing
    whole = number[capacity] - number[capacity - t]
    between = volume[capacity - t] - np.where(t > 0, volume[np.maximum(t - 1, 0)], 0)
    best = max(best, int((whole + -(-between // capacity)).max()))
    for k in range(1, 33):
        scaled = (k + 1) * size
        # In units of 1 / (k * capacity): a multiple of a (k + 1)-th keeps its share, others round down to a k-th.
        share = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * share).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the sequence of each piece and its offset there."""
    order = np.argsort(-lengths, kind="stable").tolist()
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by the room that is left
    rooms = 0  # bit r is set when some open sequence has room r
    sequence, offset, number = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in order:
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            to = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, to, number = capacity, number, number + 1
        sequence[i], offset[i] = to, capacity - room
        if room > n:
            by_room[room - n].append(to)
            rooms |= 1 << (room - n)
    return sequence, offset


def _pack(capacity: int, turn: int):
    """Pack the pieces of a group, and say for each piece whether its sequence goes back."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "id"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy()
        sequence, offset = best_fit(lengths, capacity)
        group = int(rows["group"].iloc[0])
        if turn and sequence.max() + 1 >= rows["sequence_id"].nunique():
            sequence, names = pd.factorize(rows["sequence_id"])
            ids, offset = names.to_numpy()[sequence], rows["offset"].to_numpy()
        else:
            ids = (np.int64(turn) << 56) + (np.int64(group) << 20) + sequence
        filled = np.bincount(sequence, lengths)
        certified = len(filled) <= lower_bound(lengths, capacity)
        back = filled < capacity
        if certified:
            back &= np.arange(len(filled)) == int(np.argmin(filled))
        return rows.assign(sequence_id=ids, offset=offset, back=back[sequence]).drop(columns="group")

    return pack


_PLAN = "id bigint, doc_id bigint, piece int, length bigint, sequence_id bigint, offset bigint"


def plan(lengths: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """A place for every piece: ``id``, ``sequence_id``, ``offset``. ``lengths``: ``id, doc_id, piece, length``.

    Sequence numbers: those of full pieces are negative; the others name round, group and sequence.
    """
    full = lengths.where(F.col("length") >= capacity).select(
        "id", (-F.col("id") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    rows = lengths.where(F.col("length") < capacity).select(
        "id", "doc_id", F.col("piece").cast("int").alias("piece"), F.col("length").cast("bigint").alias("length"),
        F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("offset"),
    )
    done, turn, open_sequences = full, 0, None
    while True:
        n = rows.count()
        if not n:
            return done
        groups = -(-n // group)
        dealt = F.xxhash64("id") if turn == 0 else F.xxhash64("sequence_id", F.lit(turn))
        packed = written(
            rows.withColumn("group", F.pmod(dealt, F.lit(groups)).cast("bigint")).groupBy("group").applyInPandas(
                _pack(capacity, turn), _PLAN + ", back boolean"),
            "packed",
        )
        now = packed.where("back").agg(F.count_distinct("sequence_id").alias("n")).first()["n"]
        again = groups > 1 and now and (open_sequences is None or now < open_sequences)
        settled = packed if not again else packed.where(~F.col("back"))
        done = done.unionByName(settled.select("id", "sequence_id", "offset"))
        if not again:
            return done
        rows, turn, open_sequences = packed.where("back").drop("back"), turn + 1, now


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, digest: bool = False) -> DataFrame:
    """Every piece with its place: ``doc_id, piece, start, length, ids`` (or ``ids_crc32``), ``sequence_id, offset``.

    The pieces are written once, in the order of their tokenisation; the plan is made from their lengths alone.
    """
    found = pieces(docs, vocabulary, capacity)
    if digest:
        found = found.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    # Numbers given before the table is written are fixed by it.
    found = written(found.withColumn("id", F.monotonically_increasing_id()), "pieces")
    places = plan(found.select("id", "doc_id", "piece", "length"), capacity)
    return found.join(places, "id").drop("id")
