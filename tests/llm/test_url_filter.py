from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from callrank.llm.url_filter import filter_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    i = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:i])
    j = next((j for j, c in enumerate(rest[i:]) if c in "?#"), len(rest) - i)
    return host, rest[i:][:j]


def brute(url, rules, default="allow"):
    host, path = parse(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def check(spark, urls, rules=RULES):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]], rules), urls[r["page_id"]]


def test_edge_urls(spark):
    check(spark, [None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "http://NET/x", "http://xnet/", "http://.net/",
                  "https://www.Example.NET/en/1?q=/de/#f", "http://example.com/de", "http://example.com/de/", "http://a.b.example.com/de/x",
                  "ftp://u@x.org:21/fr/", "http://x.org/fr/a", "http://x.org?/fr/", "http://é.org/fr/ü", "http://a..net//",
                  "http://" + "a." * 900 + "net/" + "p/" * 900, "http://a.net\n/x", "http://x.org/fr/a", "x://y://z.net/"])


def test_general_rules(spark):
    rules = [("com", "", "block"), ("a.com", "/de", "allow"), ("a.com", "/de", "block"), ("b.a.com", "/d", "allow"), ("", "/", "block")]
    merged = [("com", "", "block"), ("a.com", "/de", "block"), ("b.a.com", "/d", "allow"), ("", "/", "block")]
    pages = ["http://a.com/de/1", "http://b.a.com/decoy", "http://b.a.com/x", "http://com", "http://x.a.com/d"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in
           filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {i: brute(u, merged)[2:] for i, u in enumerate(pages)}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aA.:/?#netorgc", max_size=14).map(lambda t: "http://" + t), min_size=1, max_size=30))
def test_against_brute_force(spark, urls):
    check(spark, urls, [("net", "/", "block"), ("a.net", "/n", "allow"), ("org", "", "block"), ("a.org", "/", "allow")])


def test_empty_tables_and_repeats(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert filter_urls(none, rules).count() == 0
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://a.net/")], "page_id long, url string")
    assert Counter(r["verdict"] for r in filter_urls(pages, rules).collect()) == {"block": 3}
    free = filter_urls(pages, rules.where("false")).collect()
    assert [(r["rule"], r["verdict"]) for r in free] == [(None, "allow")] * 3
