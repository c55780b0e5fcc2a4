"""URL rules: the digest array, the join for large rule sets, and a brute-force reading of the rules."""

import numpy as np
import pytest

from cyclewise.llm import queries, url_filter

RULES = [*queries.URL_RULES, ("a.b", "/", "allow"), ("b", "/xyz", "block"), ("b", "/xyz", "allow"), ("B", None, "block"), ("", "/", "block"), (None, "/", "block")]
URLS = [
    None, "", "no scheme", "://", "http://", "http://NET/x", "http://x.net/en/1", "http://example.net/en/1", "http://www.Example.NET/en/?q",
    "http://example.net/en", "http://notexample.com/de/", "http://example.com/de/a#b", "http://example.com?/de/", "http://example.org/fr/",
    "http://org/fr/", "http://a.b/xyz", "http://c.a.b/xyz", "http://z.b/xyz/1", "http://z.b", "http://z.b#/", "http://example.net:80/en/",
    "x://y://net/", "http://" + "a." * 3000 + "net/", "http://net/" + "p" * 50000, "http://é.net/ü", "http://net/", "http://net/",
]


def brute(url, rules):
    url = url or ""
    at = url.find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    best = None
    for h, p, action in rules:
        h, p = (h or "").lower(), p or ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h + p), len(h), action)
            if best is None or rank > best[0]:
                best = (rank, h + p, action)
    return host, path, best[1] if best else None, best[2] if best else "allow"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, action string")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id int, url string, host string, rule string")


def test_judged(pages, rules):
    want = [(i, *brute(u, RULES)) for i, u in enumerate(URLS)]
    mapped = url_filter.judge(pages, url_filter.build_index(rules), "page_id")
    joined = url_filter.judge_by_join(pages, rules, "page_id")
    assert sorted(map(tuple, mapped.collect())) == want
    assert sorted(map(tuple, joined.collect())) == want


def test_nothing(spark, pages, rules):
    index = url_filter.build_index(rules.limit(0), default="block")
    assert {r.verdict for r in url_filter.judge(pages, index, "page_id").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), url_filter.build_index(rules), "page_id").collect() == []
    assert url_filter.judge_by_join(pages.limit(0), rules, "page_id").collect() == []
    assert {r.rule for r in url_filter.judge_by_join(pages, rules.limit(0), "page_id").collect()} == {None}


def test_equal_digests_are_told_apart(tmp_path):
    names = [b"b/", b"a/", b"c/"]
    parts = [np.array([3, 9, 1], "<u8"), np.array([1], "<u8"), np.array([7, 7, 9], "<u8"), np.array([2, 4, 6], "<u8")]
    data = b"".join(p.tobytes() for p in parts) + np.ones(3, "<u4").tobytes() + bytes([1, 0, 1]) + b"".join(names)
    (tmp_path / "index").write_bytes(data)
    digests = url_filter.Digests(str(tmp_path / "index"))
    assert isinstance(digests.keys, np.memmap)
    assert digests.find(["a/", "b/", "c/", "d/", "e/"], digest=lambda r: {b"a/": 7, b"b/": 7, b"c/": 9, b"d/": 7, b"e/": 10}[r]) == [1, 0, 2, -1, -1]


def test_size_is_checked(rules, monkeypatch):
    monkeypatch.setattr(url_filter, "INDEX_BYTES", 10)
    with pytest.raises(ValueError):
        url_filter.build_index(rules)
