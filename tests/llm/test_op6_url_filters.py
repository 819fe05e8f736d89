"""URL rules against a plain matcher."""

from __future__ import annotations

from tessera.llm import op6_url_filters as u
from tessera.llm.queries import URL_RULES

URLS = [
    "http://Example.COM/en/x", "https://www.example.com/en/y?q#f", "https://a.b.example.com/de", "https://example.net/es/1", "https://example.net/fr", "http://net/fr/", "https://notexample.com/en/", "ftp://x.org/",
    "no scheme", "", None, "http://", "http:///en/", "http://example.com", "a://b://c/d", "http://example.com?/en/", "http://com/", "http://EXAMPLE.com/EN/", "http://..com/", "http://é.com/en/\nx",
]


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_against_a_plain_matcher(spark):
    pages = spark.createDataFrame([(i, x, "old", "old") for i, x in enumerate([*URLS, *URLS])], "page_id long, url string, rule string, verdict string")
    rules = spark.createDataFrame([*URL_RULES, ("x.org", None, "block"), ("net", "/fr/", "block")], "host string, path string, verdict string")
    for rows in (100_000, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(pages, rules, broadcast_rows=rows).collect()}
        assert got == {i: plain(x, URL_RULES) for i, x in enumerate([*URLS, *URLS])}


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in u.judge(pages, none).collect()] == [(None, "allow")]
    assert u.judge(pages.limit(0), spark.createDataFrame(URL_RULES, none.schema)).collect() == []


def test_clashing_columns_null_keys_and_long_hosts(spark):
    long_host = "x." * 8000 + "example.com"
    rows = [(None, "http://www.example.com/en/a", 1, "p"), (2, f"http://{long_host}/en/", 2, "p"), (2, f"http://{long_host}/en/", 2, "p")] + [(k, None, 3, "p") for k in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, won int, part string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = u.judge(pages, rules).collect()
    assert sorted(pages.columns) == sorted(c for c in got[0].asDict() if c not in ("host", "path", "rule", "verdict"))
    assert sorted((r.page_id or -1, r.rule, r.verdict, r.won, r.part) for r in got if r.url) == [(-1, "www.example.com/en/", "allow", 1, "p"), (2, "example.com/en/", "block", 2, "p"), (2, "example.com/en/", "block", 2, "p")]
    assert sum(r.rule is None and r.verdict == "allow" and r.won == 3 for r in got) == 50


def test_a_rule_for_everything_without_a_host(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://a.com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("", "", "block")], "host string, path string, verdict string")
    assert {r.page_id: r.verdict for r in u.judge(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow"}
