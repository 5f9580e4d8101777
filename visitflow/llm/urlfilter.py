"""Verdicts on URLs from a listing of host and path prefixes, by a blocked Bloom filter and an exact join.

A listed entry ``(host, path)`` fits its host and all subdomains, where the URL's path starts with the listed one. A URL
is therefore looked up under every suffix of its host that has as many labels as some listed host, with every beginning
of its path that is as long as some listed path. The Bloom filter holds the listed entries in blocks of 64 bits, each
key setting ``BITS`` bits of one block; keys that it lets through go to an exact join with the listing, which removes
false hits. The longest entry wins (then the one of the longer host); a URL without one gets the default verdict.

The filter has at most ``MOST_BLOCKS`` words (2 MB): a listing of more entries makes more false hits, and the exact join
still decides. Different URLs are looked up once.

Null URLs and URLs without ``://`` have an empty host and path. Listed entries with a null host or path are left out; of
equal entries with different verdicts ``block`` wins. An empty listing gives everything the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 4
KEYS_PER_BLOCK = 4
MOST_BLOCKS = 1 << 18
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.concat_ws("\n", host, path)  # neither holds a line break in a listed entry that can match


def _bits(key: Column) -> Column:
    """The bits of a key in its block."""
    one, h = F.lit(1).cast("bigint"), F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", one, F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(BITS)]
    word = bits[0]
    for bit in bits[1:]:
        word = word.bitwiseOR(bit)
    return word


def bloom(listing: DataFrame, blocks: int) -> Column:
    """The filter, one array of ``blocks`` words, as a scalar subquery."""
    key = _key(F.col("host"), F.col("path"))
    words = listing.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).agg(F.bit_or(_bits(key)).alias("word"))
    every = listing.sparkSession.range(blocks).select(F.col("id").alias("block"))
    filled = every.join(words, "block", "left").select("block", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
    return filled.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("block", "word"))), lambda x: x["word"]).alias("words")
    ).scalar()


def _passes(words: Column, blocks: int, key: Column) -> Column:
    bits = _bits(key)
    return F.get(words, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).bitwiseAND(bits) == bits


def entries(listing: DataFrame) -> DataFrame:
    """``host, path, verdict`` once each."""
    return listing.where(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(
        F.max("verdict").alias("verdict"))


def judged(pages: DataFrame, listing: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """``row`` (the given row), ``host``, ``path``, ``rule`` (the longest entry that fits, or null) and ``verdict``."""
    listed = entries(listing)
    blocks = min(MOST_BLOCKS, max(16, 1 << max(0, (listed.count() // KEYS_PER_BLOCK).bit_length())))
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    labels = listed.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("n")).scalar()
    lengths = listed.agg(F.collect_set(F.length("path")).alias("n")).scalar()
    urls = rows.select("host", "path").distinct().withColumns({
        "labels": labels, "lengths": lengths, "parts": F.split("host", r"\."),
    })
    suffixes = F.transform(
        F.filter("labels", lambda n: n <= F.size("parts")),
        lambda n: F.array_join(F.slice("parts", F.size("parts") - n + 1, n), "."),
    )
    beginnings = F.transform(
        F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n)
    )
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(
        F.col("beginnings"), lambda p: F.struct(h.alias("entry_host"), p.alias("entry_path")))))
    # The filter is a value of the predicate, one for each task; no row carries it.
    possible = urls.withColumn("beginnings", beginnings).select("host", "path", F.explode(keys).alias("entry")).select(
        "host", "path", "entry.*").where(
        _passes(bloom(listed, blocks), blocks, _key(F.col("entry_host"), F.col("entry_path"))))
    exact = listed.select(F.col("host").alias("entry_host"), F.col("path").alias("entry_path"), "verdict")
    best = possible.join(exact, ["entry_host", "entry_path"]).groupBy("host", "path").agg(F.max(F.struct(
        (F.length("entry_host") + F.length("entry_path")).alias("size"), F.length("entry_host").alias("host_size"),
        F.concat("entry_host", "entry_path").alias("rule"), "verdict",
    )).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
