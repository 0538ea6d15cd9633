"""URL filters against plain Python, and cascades against a set."""

import random

import pytest
from pyspark.sql import functions as F

from tidelex.llm import url_filter

URLS = [None, "", "no scheme", "://", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y#z",
        "http://anet/", "http://net.example/", "https://example.net/en/1", "https://x.example.net/en",
        "https://x.example.net/en/", "http://a.b.example.com/de/?q=://net/", "http://example.com/de",
        "http://myexample.com/de/2", "http://org/fr/", "http://x.org/fr/a#b", "http://x.org/en/",
        "http://É.NET/ü", "http://a.net:80/", "http://.net/", "http://net./", "http://a..net/",
        "a://b://c.net/", "http://x.net?/", "http://x.net#/", "http://example.net/en/" + "y" * 50_000,
        "http://" + "a." * 3_000 + "net/deep", "http://line\nbreak.net/\n"]


def plain(url, rules):
    head, mark, rest = (url or "").partition("://")
    if not mark:
        host = path = ""
    else:
        at = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
        path = rest[at:]
        path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), h + p, action) for h, p, action in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def judged(spark, urls, rules):
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    made = url_filter.judge(table, spark.createDataFrame(
        rules, "host string, path string, action string"))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in made.collect()}


def test_contract_rules(spark):
    assert judged(spark, URLS, url_filter.RULES) == {
        n: plain(u, url_filter.RULES) for n, u in enumerate(URLS)}


@pytest.mark.parametrize("bits", [url_filter.MAX_BITS, 300])
def test_many_rules(spark, monkeypatch, bits):
    """Nested rules, rules without a path, equal lengths; with and without parts."""
    monkeypatch.setattr(url_filter, "MAX_BITS", bits)
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "cc", "net", "é"])
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda: rng.choice(["", "/", "/a", "/a/", "/a/b", "/aé"])
    rules = sorted({(host(rng.randrange(1, 4)), path()): rng.choice(["allow", "block"])
                    for _ in range(60)}.items())
    rules = [(h, p, action) for (h, p), action in rules]
    urls = [f"http://{host(rng.randrange(1, 5))}{path()}{rng.choice(['', 'x', '?a', '#/'])}"
            for _ in range(400)]
    assert judged(spark, urls, rules) == {n: plain(u, rules) for n, u in enumerate(urls)}


def test_no_rules_no_rows_and_listed_both_ways(spark):
    assert judged(spark, ["http://a.net/"], [])[0] == ("a.net", "/", None, "allow")
    assert judged(spark, [], url_filter.RULES) == {}
    both = [("a", "/", "block"), ("a", "/", "allow"), ("A", "/", "block")]
    assert judged(spark, ["http://a/"], both)[0] == ("a", "/", "a/", "allow")
    with pytest.raises(ValueError):
        judged(spark, ["http://a/"], [("", "/", "block")])
    with pytest.raises(ValueError):
        judged(spark, ["http://a/"], [("a", "/", "maybe")])


def test_columns_and_repeated_rows(spark):
    table = spark.createDataFrame([(1, "http://a.net/")] * 3, "page_id long, url string")
    table = table.withColumns({c: F.lit("old") for c in (
        "host", "path", "rule", "verdict", "key", "keys", "h1", "h2", "at", "found", "action")})
    rows = url_filter.judge(table, spark.createDataFrame(
        url_filter.RULES, "host string, path string, action string"))
    assert [tuple(rows.select("page_id", "host", "rule", "verdict", "key", "at").collect()[n])
            for n in range(3)] == [(1, "a.net", "net/", "block", "old", "old")] * 3


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).select(
        "key", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit("second")).alias("h2"))
    listed = keys.where("key LIKE 'k1%7'")
    levels = url_filter.cascade(listed, keys, listed.count(), 20_000)
    assert len(levels) > 2
    table = keys.toPandas()
    got = url_filter._listed(levels, table["h1"].to_numpy().view("u8"),
                             table["h2"].to_numpy().view("u8"))
    assert set(table["key"][got]) == {r.key for r in listed.collect()}
