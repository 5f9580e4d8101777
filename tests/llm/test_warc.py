import hashlib
import random

from pyspark.sql import functions as F

from visitflow.llm import warc as W
from visitflow.llm.shared import new_folder

SCHEMA = "page_id bigint, url string, html string"
BIG = "payload " * 200


def _pages(spark, extra=()):
    data = [
        (1, "http://a.example.com/x?q=1#f", BIG), (2, "https://b.example.com/", BIG), (3, "http://a.example.com/x?q=1", BIG),
        (4, "http://a.example.com/é\r\n b%20", "small"), (5, None, "small"), (6, "no scheme", None), (7, "", ""),
        (8, "http://c.example.com/", "line\r\n\r\nWARC/1.1\r\n\r\n" * 80), (None, "http://n.example.com/", BIG + "n"),
        *extra,
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_archives_round_trip(spark):
    got = {r["page_id"]: r for r in W.captures(_pages(spark)).collect()}
    assert len(got) == 9
    assert {i for i, r in got.items() if r["record_type"] == "revisit"} == {1, 2}
    assert got[1]["refers_to"] == got[2]["refers_to"] == 3 and got[3]["refers_to"] is None
    assert got[1]["payload_bytes"] == len(BIG) and got[1]["payload_digest"] == got[3]["payload_digest"]
    assert got[4]["url"] == "http://a.example.com/é\r\n b%20" and got[5]["url"] == ""
    assert (got[6]["payload_bytes"], got[7]["payload_bytes"]) == (0, 0)


def test_index_is_globally_ordered(spark, monkeypatch):
    monkeypatch.setattr(W, "ARCHIVE", 4_000)
    rng = random.Random(1)
    extra = [(100 + i, f"http://{rng.choice('abc')}.example.com/{rng.randrange(9)}", f"t{i}") for i in range(600)]
    pages = _pages(spark, extra).repartition(9)
    folder = new_folder(spark, "warc")
    runs = W.capture_runs(W.written_archives(pages, folder))
    assert runs.select("run").distinct().count() > 1
    merged = sorted(W.merged_index(runs, 100).collect(), key=lambda r: (r["part"], r["position"]))
    keys = [(r["url_key"], r["captured"], r["page_id"] or -1) for r in merged]
    assert keys == sorted(keys) and len(keys) == 609
    assert len({r["part"] for r in merged}) > 3
    r = merged[300]
    found = [raw for at, _, raw in W.members(r["archive"]) if at == r["offset"]]
    assert W.parsed(found[0])["page_id"] == r["page_id"]


def test_loser_tree_merges():
    rng = random.Random(2)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(W.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_repeated_rows_and_empty_tables(spark):
    pages = _pages(spark).unionByName(_pages(spark))
    got = W.captures(pages)
    assert got.count() == 18 and got.where("record_type = 'revisit'").count() == 4
    assert W.captures(pages.limit(0)).count() == 0


def test_damage_is_noticed():
    raw = W.record(1, "http://x/", "2024-01-01T00:00:01Z", b"abc", "0" * 40, None)
    try:
        W.parsed(raw)
    except ValueError as error:
        assert "digest" in str(error)
    else:
        raise AssertionError("a wrong digest was accepted")


def test_very_long_payloads_and_extra_columns(spark):
    """Payloads beyond any block that is read at once, equal and different ones, and columns named like the record's."""
    long = "".join(chr(97 + i * i % 26) for i in range(50_000)) * 90  # 4.5 MB
    data = [(1, "http://a.example.com/" + "p" * 100_000, long), (2, "http://b.example.com/", long), (3, "http://c/", long + "x")]
    pages = spark.createDataFrame(data, SCHEMA)
    for name in ("payload", "record_type", "refers_to", "run", "part", "offset", "archive", "captured", "url_key"):
        pages = pages.withColumn(name, F.lit(name))
    got = {r["page_id"]: r for r in W.captures(pages).collect()}
    assert {i: r["payload_bytes"] for i, r in got.items()} == {1: len(long), 2: len(long), 3: len(long) + 1}
    assert (got[1]["record_type"], got[1]["refers_to"]) == ("revisit", 2) and got[2]["record_type"] == "response"
    assert got[3]["payload_digest"] == hashlib.sha1((long + "x").encode()).hexdigest()
