import random

from pyspark.sql import functions as F

from visitflow.llm import urlfilter as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("x.net", "", "block"), ("example.com", "/en/", "allow"), (None, "/", "block")]


def _brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for h, p, verdict in RULES:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1, -1, "", ""), (len(h) + len(p), len(h), h + p, verdict))
    return (host, path, best and best[2], best[3] if best else "allow")


URLS = [None, "", "no scheme", "http://", "://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com?/en/", "http://É.com/",
        "http://a.example.com/en/", "http://example.com/en", "http://myexample.com/en/", "http://x.net", "http://a.x.net/es/",
        "http://net/es/a#b", "a://b://c.com/", "http://user@h.com:80/p", "http://" + "a." * 300 + "net/es/" + "p" * 5000]


def test_verdicts_are_those_of_brute_force(spark):
    rng = random.Random(1)
    urls = URLS + [
        f"http://{rng.choice(['a.', 'www.', ''])}{rng.choice(['example.com', 'x.net', 'y.net', 'z.org'])}"
        f"{rng.choice(['/', '/en/', '/es/', '', '/e'])}{rng.choice(['', 'q', '?a', '#b'])}" for _ in range(200)
    ]
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    listing = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = U.judged(pages, listing).select("row.page_id", "row.host", "host", "path", "rule", "verdict").collect()
    assert len(got) == len(urls)
    for r in got:
        assert tuple(r)[2:] == _brute(urls[r["page_id"]]), urls[r["page_id"]]
        assert tuple(r)[1] == "own"


def test_large_listing_and_empty_tables(spark):
    listing = spark.range(3000).selectExpr("concat('h', id, '.org') AS host", "concat('/p', id % 7, '/') AS path",
                                           "'block' AS verdict")
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://www.h', id, '.org/p', id % 5, '/x') AS url")
    got = U.judged(pages, listing)
    assert got.where("verdict = 'block'").count() == sum(i % 7 == i % 5 for i in range(3000))
    assert U.judged(pages, listing.limit(0)).where("verdict = 'allow' AND rule IS NULL").count() == 4000
    assert U.judged(pages.limit(0), listing).count() == 0


def test_very_long_urls_and_extra_columns(spark):
    urls = ["http://" + "a." * 2000 + "example.com/en/" + "p" * 200_000, "http://" + "x" * 100_000, None, ""]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    for name in ("host", "path", "rule", "verdict", "row", "labels", "lengths", "parts", "words", "entry", "best"):
        pages = pages.withColumn(name, F.lit(name))
    listing = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judged(pages, listing).select(
        "row.page_id", "rule", "verdict").collect()}
    assert got == {0: ("example.com/en/", "block"), 1: (None, "allow"), 2: (None, "allow"), 3: (None, "allow")}
