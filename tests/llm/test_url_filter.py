"""Addresses judged by rules and by a list, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_filter
from tidemark.llm.registry import URL_RULES

URLS = ["http://a.org/x", "http://A.Org", "https://www.example.org/es/1", "https://example.org/en/12", "https://example.org/en/2", "http://badexample.org/es/1", "http://com/fr/1", "http://x.com/de/9#a", "http://x.com/de?x",
        None, "", "no scheme", "://", "://h", "http://", "http:///p", "http://spam.net/a/?utm_source=f&b=2&a=1#z", "https://www.SPAM.net/a?a=1&b=2", "http://spam.net/A?a=1&b=2", "http://spam.net/a?a=1", "http://clean.net/a",
        "http://user@h.com:80/fr/x?y://z", "http://x.net/" + "q" * 50_000, "a://b://c", "http://spam.net/a?ref=x&b=2&a=1", "http://exa\nmple.org/es/\n1"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def form(url):
    host, path = split(url)
    if not host.removeprefix("www."):
        return None
    asked = url.split("://", 1)[1].split("#")[0].partition("?")[2]
    kept = "&".join(sorted(p for p in asked.split("&") if p and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|$)", p)))
    return host.removeprefix("www.") + path.rstrip("/") + (f"?{kept}" if kept else "")


def expected(url, listed, rules):
    host, path = split(url)
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    if fits:
        act, a, b = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block"))
        return host, path, a + b, act
    return host, path, None, "block" if form(url) in {form(u) for u in listed} - {None} else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(16, URLS[16]), (None, URLS[17])], "page_id long, url string").select(
        "*", F.lit("x").alias("host"), F.lit(1).alias("block"), F.lit(0).alias("w0"), F.lit("c").alias("canonical")).repartition(3)


@pytest.mark.parametrize("listed", [[], [None, ""], ["http://spam.net/a?a=1&b=2", "http://spam.net/a?a=1&b=2", None, "http://gone.net/"], [f"http://l{i}.net/{i}" for i in range(300)] + ["://h", "http://x.com/de/9"]])
@pytest.mark.parametrize("rules", [[], URL_RULES])
def test_judged_like_plain_python(spark, pages, listed, rules):
    given = spark.createDataFrame([(u,) for u in listed], "url string").withColumn("page_id", F.lit(1))
    want = [(i, *expected(u, listed, rules)) for i, u in [*enumerate(URLS), (16, URLS[16]), (None, URLS[17])]]
    for more in ({}, {"max_blocks": 1, "salts": 3}):
        got = url_filter.judge(pages, given, rules, **more)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_equal_lengths_prefer_the_longer_host_and_block(spark):
    pages = spark.createDataFrame([(1, "http://b.cd/x"), (2, "http://q.cd/xyz")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, none, [("allow", "b.cd", "/x"), ("block", "b.cd", "/x"), ("allow", "q.cd", "/x"), ("block", "cd", "/xyz")]).collect()}
    assert got == {1: ("b.cd/x", "block"), 2: ("q.cd/x", "allow")}


def test_filter_never_misses_and_passes_few(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("h.net/"), "id").alias("canonical"))
    others = spark.range(20_000, 60_000).select(F.concat(F.lit("h.net/"), "id").alias("canonical"))
    blocks = -(-20_000 * url_filter.BITS_PER_URL // 512)
    made = url_filter.bloom(listed, blocks)

    def passed(rows):
        hit = [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(url_filter._bits(F.col("canonical")))]
        placed = rows.withColumn("block", url_filter._block(F.col("canonical"), blocks)).join(made, "block")
        return placed.filter(hit[0] & hit[1] & hit[2] & hit[3] & hit[4] & hit[5] & hit[6] & hit[7]).count()
    assert passed(listed) == 20_000 and passed(others) < 0.02 * 40_000


def test_empty_table_and_hot_address(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    hot = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://spam.net/a").alias("url"))
    assert url_filter.judge(none, hot).count() == 0
    got = url_filter.judge(hot, hot).groupBy("verdict").count().collect()
    assert [tuple(r) for r in got] == [("block", 3000)]


def test_unwanted_hosts(spark):
    pages = spark.createDataFrame([("http://free-bets.a.com/x",), ("http://bestbets.com/",), ("http://x.com/spam",), ("http://SPAM.com",), (None,)], "url string")
    assert sorted(r["url"] for r in url_filter.unwanted(pages).collect()) == ["http://SPAM.com", "http://free-bets.a.com/x"]
