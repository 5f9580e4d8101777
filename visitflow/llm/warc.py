"""Web archives: records with revisits for equal payloads, and a capture index merged from sorted runs.

* Pages are written as WARC 1.1 records, one gzip member each, into archives of about ``ARCHIVE`` bytes in the shared
  folder. Of pages with equal payloads of ``REVISIT`` bytes or more, the one of largest id is a ``response`` record with
  the payload; the others are ``revisit`` records that refer to it. Payloads are compared by SHA-1.
* Reading an archive back checks every payload against its digest and gives one *run*: its captures sorted by URL key,
  time and id.
* The runs are dealt out by ranges of that order, and each range is merged from its slices of all runs by a loser tree;
  the ranges one after the other are the globally ordered capture histories.

A task that is run again writes an archive of a new name, and only archives that a finished task reports are read. A
null payload is empty, a null URL an empty target, a null page_id lower than all others. Repeated rows are records each; of several rows with the winning id
every one is a response.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitflow.llm.shared import new_folder, travels, written

travels(__name__)

REVISIT = 1_000
ARCHIVE = 64_000_000
RANGE = 50_000  # captures of one range of the merged index
EPOCH = 1_704_067_200  # capture time of page 0 where a table has none: 2024-01-01
NO_ID = -(1 << 63)  # stands for a null page_id inside
# --- fixed values: words of the archive format ---------------------------------------------------------------------
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# --- end of fixed values -------------------------------------------------------------------------------------------
_SAFE = "".join(chr(c) for c in range(33, 127) if c not in b'%')

CAPTURE = (
    "run string, url_key string, captured bigint, page_id bigint, url string, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, archive string, offset bigint, length bigint"
)
_COLUMNS = [part.split()[0] for part in CAPTURE.split(", ")]


def record(page: int, url: str, captured: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP head, with the length of the payload, and leaves out the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", captured),
        ("WARC-Target-URI", quote(url, safe=_SAFE)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The capture that a record holds; a wrong length or digest is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(fields["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if f"{version}\r\n".encode() != VERSION or len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("damaged archive record")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda name: int(fields[name].removeprefix("<urn:page:").rstrip(">"))
    url = unquote(fields["WARC-Target-URI"])
    return {
        "url_key": url_key(url), "captured": int(pd.Timestamp(fields["WARC-Date"]).timestamp()),
        "page_id": number("WARC-Record-ID"), "url": url, "record_type": kind,
        "refers_to": number("WARC-Refers-To") if kind == "revisit" else None,
        "payload_bytes": length, "payload_digest": digest,
    }


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query: captures of a site sort together."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host = re.split(r"[/?]", rest, maxsplit=1)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + rest[len(host):]


def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, path, size, records = None, "", 0, 0
        for rows in batches:
            for row in rows.itertuples(index=False):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, name = _file(path)
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out, size, records = system.open_output_stream(name, compression=None), 0, 0
                refers_to = None if pd.isna(row.refers_to) else int(row.refers_to)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = record(row.page_id, row.url, row.captured, row.payload, row.digest, refers_to)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= ARCHIVE:
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [path], "bytes": [size], "records": [records]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [path], "bytes": [size], "records": [records]})

    return write


def written_archives(pages: DataFrame, folder: str, captured: Column | None = None) -> DataFrame:
    """``archive, bytes, records`` of the archives with all pages (``page_id``, ``url``, ``html``).

    Digests are counted first; payloads move once, to meet their group's winner. A digest that many pages share is a hot
    key of that join only, which adaptive execution splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    time = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))) if captured is None else captured
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"),
        F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    )
    winners = rows.where(F.octet_length("payload") >= REVISIT).groupBy("digest").agg(
        F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "winner")
    records = rows.join(winners.hint("merge"), "digest", "left").withColumn(
        "refers_to", F.when(F.col("winner") != F.col("page_id"), F.col("winner"))).drop("winner")
    return written(
        records.mapInPandas(_writer(folder), "archive string, bytes bigint, records bigint"), "archives"
    )


def members(path: str, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of the gzip members of an archive, read as a stream."""
    system, name = _file(path)
    with system.open_input_stream(name, compression=None) as source:
        rest, at = source.read(block), 0
        while rest:
            inflate, parts, used = zlib.decompressobj(31), [], 0
            while not inflate.eof:
                if not rest:
                    rest = source.read(block)
                    if not rest:
                        raise ValueError(f"{path} ends inside a record")
                parts.append(inflate.decompress(rest))
                used += len(rest) - len(inflate.unused_data)
                rest = inflate.unused_data
            yield at, used, b"".join(parts)
            at += used
            rest = rest or source.read(block)


def _order(capture: dict) -> tuple:
    return capture["url_key"], capture["captured"], capture["page_id"]


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for path in rows["archive"]:
            run = [
                {**parsed(raw), "run": path, "archive": path, "offset": at, "length": length}
                for at, length, raw in members(path)
            ]
            run.sort(key=_order)
            yield pd.DataFrame(run, columns=_COLUMNS).astype({"refers_to": "Int64"})


def capture_runs(archives: DataFrame) -> DataFrame:
    """The captures of every archive, one sorted run each, as a table."""
    return written(
        archives.select("archive").repartition(max(1, archives.count())).mapInPandas(_runs, CAPTURE), "runs"
    )


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, runs: Sequence[Sequence], key) -> None:
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.losers = [-1] * self.k
        self.heads = [self._head(i) if runs else None for i in range(self.k)]
        for i in range(self.k):
            self._replay(i, building=True)

    def _head(self, i: int):
        return self.key(self.runs[i][self.at[i]]) if self.at[i] < len(self.runs[i]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if other >= 0 and self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        if not self.runs:
            return
        while self.heads[self.losers[0]] is not None:
            best = self.losers[0]
            yield self.runs[best][self.at[best]]
            self.at[best] += 1
            self.heads[best] = self._head(best)
            self._replay(best)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs: dict[str, list[tuple]] = {}
    for rows in batches:
        for row in rows[_COLUMNS].itertuples(index=False, name=None):
            runs.setdefault(row[0], []).append(row)
    order = lambda row: row[1:4]
    for run in runs.values():
        run.sort(key=order)  # a slice of a sorted run: blocks of it may come in any order
    merged = list(LoserTree(list(runs.values()), order))
    part = TaskContext.get().partitionId()
    for low in range(0, len(merged), 20_000):
        out = pd.DataFrame(merged[low:low + 20_000], columns=_COLUMNS).astype({"refers_to": "Int64"})
        yield out.drop(columns="run").assign(part=part, position=range(low, low + len(out)))


def merged_index(runs: DataFrame, size: int = RANGE) -> DataFrame:
    """All captures in the order of URL key, time and id: by ``part``, then ``position``."""
    parts = max(1, -(-runs.count() // size))
    merged = runs.repartitionByRange(parts, "url_key", "captured", "page_id").mapInPandas(
        _merge, CAPTURE.removeprefix("run string, ") + ", part int, position bigint")
    return merged.withColumn("page_id", F.nullif("page_id", F.lit(NO_ID)))


def captures(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back and merge the index."""
    to = folder or new_folder(pages.sparkSession, "warc")
    return merged_index(capture_runs(written_archives(pages, to)))
