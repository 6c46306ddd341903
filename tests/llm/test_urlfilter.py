import pytest
from pyspark.sql import functions as F

from epicohort.llm import urlfilter as U

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
         ("a+b.org/x", "block")]
URLS = [None, "", "no scheme", "://", "http://example.com/en/1", "http://EXAMPLE.com/en/1", "https://www.example.com/en/?q=/x",
        "https://sub.www.example.com/en/x", "https://badexample.com/en/1", "https://x.net/es/1#top", "https://x.net/es", "https://net/fr/",
        "ftp://x.com", "ftp://x.com/?a", "http://x.net/de/http://y.com/en/", "http://É.NET/es/é", "http://h.com:80/a", "a://b://c/d",
        "http://a+b.org/xyz", "http://aab.org/xyz", "http://x.net/es/\nnext"]


def brute(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, verdict in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return (host, path, *(best or (None, "allow")))


@pytest.mark.parametrize("bound", [U.BROADCAST_RULES, 0])
def test_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(U, "BROADCAST_RULES", bound)
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS * 2)] + [(0, URLS[4], "h", "v")] + [(None, URLS[5], "h", "v")],
                                  "page_id long, url string, host string, verdict string")
    rows = U.filter_urls(pages, U.rule_table(spark, RULES), len(RULES)).collect()
    want = [(i, *brute(u)) for i, u in enumerate(URLS * 2)] + [(0, *brute(URLS[4])), (None, *brute(URLS[5]))]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_rarest_token_and_empty_tables(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example.com/en/{i}") for i in range(20)] + [(99, "http://rare.net/en/")], "page_id long, url string")
    host, path = U.url_parts(pages["url"])
    urls = pages.select(U.url_tokens(host, path).alias("tokens"))
    rules = U.rule_table(spark, [("example.com/en/", "block"), ("rare.net/en/", "block")])
    index = {r["rule"]: r["token"] for r in U.index_rules(urls, rules).collect()}
    assert index["rare.net/en/"] in ("rare", "net") and index["example.com/en/"] in ("com", "example")
    assert U.filter_urls(pages.limit(0), rules, 2).count() == 0
    assert {r["verdict"] for r in U.filter_urls(pages, rules.limit(0), 0).collect()} == {"allow"}


def test_tokens_are_counted_before_the_shuffle(spark, monkeypatch):
    """Neither form of the index shuffles a row for each token of each URL."""
    urls = spark.createDataFrame([(f"h{i}.example.com", "/en/a/b") for i in range(50)], "host string, path string")
    urls = urls.withColumn("tokens", U.url_tokens(F.col("host"), F.col("path")))
    rules = U.rule_table(spark, [("example.com/en/", "block"), ("com/", "allow"), ("absent/x/", "block")])
    for most in (U.BROADCAST_RULES, 1):
        monkeypatch.setattr(U, "BROADCAST_RULES", most)
        index = U.index_rules(urls, rules, 3)
        lines = index._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
        seen = 0
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning(token" in line:
                below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
                if "explode(filter" in "".join(lines[i:below]):
                    assert "partial_count" in lines[i + 1]
                    seen += 1
        assert seen == 1
        assert {r["rule"]: r["token"] for r in index.collect()} == {"example.com/en/": "com", "com/": "com", "absent/x/": "absent"}


def test_very_long_url_and_empty_table(spark):
    long = "http://www.example.com/en/" + "segment/" * 20_000 + "?q=" + "z" * 100_000
    pages = spark.createDataFrame([(1, long, "x", "y"), (2, long.replace("/en/", "/xx/"), "x", "y")], "page_id long, url string, host string, _row string")
    rules = U.rule_table(spark, [("example.com/en/", "block")])
    got = {r["page_id"]: (r["host"], len(r["path"]), r["rule"], r["verdict"]) for r in U.filter_urls(pages, rules, 1).collect()}
    assert got == {1: ("www.example.com", 160_004, "example.com/en/", "block"), 2: ("www.example.com", 160_004, None, "allow")}
    assert U.filter_urls(pages.limit(0), rules, 1).count() == 0
