import pytest

from ratewell import scale
from ratewell.llm.queries import URL_RULES
from ratewell.llm.url_filter import judge

URLS = [
    None, "", "no scheme", "http://net", "http://net/", "HTTP://WWW.Example.NET/en/1?x#y", "http://example.net/en", "http://a.example.net/de/1",
    "http://notexample.com/de/", "http://example.com/de/a/b", "x://example.com/de/", "http://org/fr/", "http://a.org/fr/x", "http://a.org?/fr/",
    "http://.net/", "http://a..net/x", "http://example.net:80/en/", "http:///net/", "a://b://c.net/", "http://" + "l." * 3000 + "net/" + "p/" * 3000,
    "http://ÄÖ.net/", "http://x.net/\n", "http://example.net/en/", "http://example.net/en/",
]


def expected(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [scale.BROADCAST_BYTES, 0])
def test_judge_like_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", limit)
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame(URL_RULES + [URL_RULES[0]], "host string, path string, action string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(pages, rules).collect()}
    assert got == {i: expected(u) for i, u in enumerate(URLS)}


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert judge(pages, rules.limit(0)).first()["verdict"] == "allow"
    assert judge(pages.limit(0), rules).collect() == []


def test_block_wins_a_tie_and_any_path_prefix_counts(spark):
    rules = spark.createDataFrame([("a.b", "/x", "allow"), ("a.b", "/x", "block"), ("b", "/xyz", "allow")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "s://a.b/xyzz"), (2, "s://c.b/xyzz"), (3, "s://c.b/xy")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge(pages, rules).collect()}
    assert got == {1: ("a.b/x", "block"), 2: ("b/xyz", "allow"), 3: (None, "allow")}
