"""Repeated passages of lines, found by content-defined chunks.

* A rolling hash over the hashes of ``ROLL`` lines with words chooses boundaries, so that a passage is cut alike wherever
  it stands; lines of ``LONG`` words are chunks of their own, and lines without words are neither hashed nor boundaries,
  but belong to the chunk around them. ``MIXES`` of the hash cut in several ways, since a short passage may hold no whole
  chunk of one of them. A chunk counts when it has two lines with words and ``SHORT`` words, or ``LONG`` words.
* Chunks of one digest form a group; the one of lowest (doc_id, row, line) is its original, and the bytes of each other
  one are compared with it.
* A confirmed copy grows, line by line, as far as the lines before and behind it equal those around the original (by
  64-bit hash), at most over the neighbouring chunk that counts: a passage that goes on there is confirmed by that chunk itself. So
  passages lose their edges, too, which boundaries rarely meet, and the lines without words beside them.

Copies go, originals stay: what a line is removed for always stands earlier, so one copy of every passage is left. A
document that loses all its lines with words goes; one that had none before stays.

Joins are merge joins at every size, since both sides grow with the documents.

Null and empty texts have no chunks and stay as they are. Rows equal in id and text are one document: both stay or are
cut alike. Rows of a null id come first in the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.llm.shared import row_key, text_slices, travels, written

travels(__name__)

ROLL = 2  # lines with words that a rolling hash covers
EVERY = 2  # lines from one boundary of a mix to the next, on average
MIXES = tuple((0x9E3779B97F4A7C15 * (2 * i + 1) ** 3 | 1) % (1 << 64) for i in range(8))  # odd factors
SHORT = 12
LONG = 20

CHUNK = "key binary, doc_id bigint, start int, lines int, digest binary, before array<bigint>, after array<bigint>"


def _hash(line: bytes) -> int:
    return int.from_bytes(blake2b(line, digest_size=8).digest(), "little", signed=True)


def chunk_bounds(
    hashes: list[int], words: list[int], mix: int = MIXES[0], roll: int = ROLL, every: int = EVERY
) -> list[tuple[int, int]]:
    """Ranges of lines with words, one after the other, cut by their content: behind every line where the rolling hash says
    so, and around every line of ``LONG`` words."""
    out, start, rolled = [], 0, 0
    weight = pow(31, roll, 1 << 64)
    for i, h in enumerate(hashes):
        rolled = (rolled * 31 + h) % (1 << 64)
        if i >= roll:
            rolled = (rolled - hashes[i - roll] * weight) % (1 << 64)
        if words[i] >= LONG and i > start:
            out.append((start, i))
            start = i
        if words[i] >= LONG or (rolled * mix % (1 << 64) >> 32) % every == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(hashes):
        out.append((start, len(hashes)))
    return out


def chunk_ranges(raw: list[bytes]) -> dict[tuple[int, int], tuple[int, int]]:
    """Chunks that count, as ranges of lines, with the start of the one before and the end of the one behind.

    Of a range that several mixes cut, the widest surroundings.
    """
    words = [len(line.split()) for line in raw]
    at = [i for i, n in enumerate(words) if n]
    hashes, sizes = [_hash(raw[i]) for i in at], [words[i] for i in at]
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for mix in MIXES if at else ():
        whole = []
        for a, b in chunk_bounds(hashes, sizes, mix):
            n = sum(sizes[a:b])
            if n >= LONG or n >= SHORT and b - a > 1:
                whole.append((at[a], at[b - 1] + 1))
        for j, place in enumerate(whole):
            low = whole[j - 1][0] if j else 0
            high = whole[j + 1][1] if j + 1 < len(whole) else len(raw)
            before = found.get(place, (low, high))
            found[place] = (min(low, before[0]), max(high, before[1]))
    return found


def chunks_of(text: str | None) -> Iterator[tuple[int, int, bytes, list[int], list[int]]]:
    """Chunks: start, lines, digest, and the hashes of the lines before and behind them, nearest first."""
    if not text:
        return
    raw = text.encode("utf-8", "replace").split(b"\n")
    found = chunk_ranges(raw)
    hashes = [_hash(line) for line in raw] if found else []
    for (a, b), (low, high) in sorted(found.items()):
        yield a, b - a, blake2b(b"\n".join(raw[a:b]), digest_size=16).digest(), hashes[low:a][::-1], hashes[b:high]


def _chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for low, high in text_slices(rows["text"].tolist()):
            part = rows.iloc[low:high]
            found = [
                (key, doc, *chunk)
                for key, doc, text in zip(part["key"], part["doc_id"], part["text"], strict=True)
                for chunk in chunks_of(text)
            ]
            if found:
                yield pd.DataFrame(
                    found, columns=["key", "doc_id", "start", "lines", "digest", "before", "after"]
                ).astype({"doc_id": "Int64"})


def _bytes_at(texts: pd.Series, ranges: pd.Series) -> pd.Series:
    """The bytes of ranges ``(start, lines)`` of a text."""
    out = []
    for text, wanted in zip(texts, ranges, strict=True):
        raw = text.encode("utf-8", "replace").split(b"\n")
        out.append([b"\n".join(raw[r["start"]:r["start"] + r["lines"]]) for r in wanted])
    return pd.Series(out, dtype=object)


def _without(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    """Texts without ranges ``(start, end)`` of lines."""
    out = []
    for text, wanted in zip(texts, ranges, strict=True):
        lines = text.split("\n") if text else []
        gone = sorted({i for r in (wanted if wanted is not None else ()) for i in range(r["start"], r["end"])})
        if gone:
            away = set(gone)
            left = [line for i, line in enumerate(lines) if i not in away]
            out.append(("\n".join(left), len(lines), gone, not any(line.split() for line in left)))
        else:
            out.append((text, len(lines), [], False))
    return pd.DataFrame(out, columns=["clean", "n_lines", "gone", "empty"])


def _common(a: Column, b: Column) -> Column:
    """How many leading elements are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("int")


def copied_lines(docs: DataFrame) -> DataFrame:
    """``key`` and ``ranges`` of lines to remove (``start``, ``end``) of each document that holds copies.

    ``docs``: ``key``, ``doc_id``, ``text``. Only digests are shuffled for all chunks; bytes move for chunks whose
    digest occurs twice.
    """
    chunks = written(docs.where(F.col("text") != "").mapInPandas(_chunked, CHUNK), "chunks")
    place = F.struct("doc_id", "key", "start")
    groups = chunks.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "start", "before", "after")).alias("first")
    ).where("n > 1")
    # An original takes part with the rest, for its bytes.
    repeated = written(
        chunks.join(groups.hint("merge"), "digest").select(
            "key", "doc_id", "start", "lines", "digest",
            (F.struct("first.doc_id", "first.key", "first.start").eqNullSafe(place)).alias("original"),
            F.least(_common(F.col("before"), F.col("first.before")), F.col("start")).alias("up"),
            _common(F.col("after"), F.col("first.after")).alias("down"),
        ),
        "repeated",
    )
    wanted = repeated.dropDuplicates(["key", "start", "lines"]).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "lines", "digest", "original", "up", "down"))).alias("ranges")
    )
    own = docs.select("key", "text").join(wanted.hint("merge"), "key")
    lines_at = F.pandas_udf(_bytes_at, "array<binary>")
    bytes_of = own.select("key", "ranges", lines_at("text", "ranges").alias("bytes")).select(
        "key", F.explode(F.arrays_zip("ranges", "bytes")).alias("x")
    ).select("key", "x.ranges.*", "x.bytes")
    copies, originals = bytes_of.where(~F.col("original")), bytes_of.where("original")
    first = originals.groupBy("digest").agg(F.first("bytes").alias("same"))
    confirmed = copies.join(first.hint("merge"), "digest").where(F.col("bytes") == F.col("same"))
    return confirmed.groupBy("key").agg(F.collect_set(F.struct(
        (F.col("start") - F.col("up")).alias("start"), (F.col("start") + F.col("lines") + F.col("down")).alias("end")
    )).alias("ranges"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``row`` (the given row), ``clean`` text, ``n_lines``, ``gone`` (line numbers removed) and ``empty`` (all gone)."""
    keyed = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("key"))
    texts = keyed.select("key", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.col("row.text").alias("text"))
    ranges = written(copied_lines(texts), "copied-lines")
    # Told to be unrepeatable, it is not computed once for a filter on its result and once more for the rows that pass.
    cut = F.pandas_udf(_without, "clean string, n_lines int, gone array<int>, empty boolean").asNondeterministic()
    out = keyed.join(ranges.hint("merge"), "key", "left").select("row", cut("row.text", "ranges").alias("cut"))
    return out.select("row", "cut.*")


def without_copies(docs: DataFrame) -> DataFrame:
    """All columns, with copied passages removed from the text, without documents that consist of copies only."""
    fields = [F.col("clean").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return deduplicated(docs).where(~F.col("empty")).select(*fields)
