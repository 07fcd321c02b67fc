import pytest
from comparing import differences, duck

from tablescope.llm import queries, urls

RULES = [
    ("Org", "/", "allow"), ("example.org", "/es/", "block"), ("a.example.org", "", "allow"), ("example.org", None, "block"),
    (None, "/", "block"), ("", "/", "block"), ("com", "/x", None), ("net", "/", "allow"), ("net", "/", "block"),
]
URLS = [
    "http://example.org/es/1", "https://WWW.Example.org/en?x=/es/", "http://b.a.example.org/es/", "http://notexample.org/q#z",
    "http://org", "http://x.net/", "http://com/x", None, "", "example.org/es/", "ftp://a://b/c", "http:///es/",
    "http://www.example.org/es/", "http://example.org", "http://x.net/", "http://x.net/" + "y" * 100000,
]


def brute(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:n].lower(), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for h, p, v in RULES:
        h, p = (h or "").lower(), p or ""
        if h and v and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(x for x in (best, (len(h), len(p), h + p, v)) if x)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("most", [100, 2])
def test_against_every_rule(spark, most):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, Verdict string")
    found = urls.filter_urls(pages, rules, slice_rules=most)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_empty_tables(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://example.org/es/")], "page_id long, url string")
    assert urls.filter_urls(pages.limit(0), rules).collect() == []
    row = urls.filter_urls(pages, rules.limit(0), default="block").first()
    assert (row["rule"], row["verdict"]) == (None, "block")


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert differences(queries.QUERIES["op10_url_filters"](spark, folder), duck(folder), queries.SQL["op10_url_filters"]) == []
