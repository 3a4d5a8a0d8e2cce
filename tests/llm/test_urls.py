import numpy as np

from veritrail.llm import urls


def plain(url):
    """(host, path, rule, verdict) by trying every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    bad = any(host == h or host.endswith("." + h) for h in urls.BLOCKED_HOSTS)
    return host, path, None, "block" if bad else "allow"


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1", "http://a.example.org/en/12#x", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/a?b", "http://org?x/", "http://xorg/", "http://m.free-bets.example.com/en/1", "http://FREE-bets.example.com?q=://a/b", "http://a://b/c", "http://ÀB.com/de/\nx", "x" * 100_000 + "://y.org/"]


def test_frame(spark):
    pages = spark.createDataFrame([(k, u, "old") for k, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, rule string")
    got = urls.judge_urls(pages)
    assert set(got.columns) == {"page_id", "url", "host", "path", "rule", "verdict"}
    for r in got.collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url), r.url
    assert urls.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules=(), blocked_hosts=()).collect()} == {"allow"}


def test_colliding_digests_never_decide(tmp_path, monkeypatch):
    monkeypatch.setattr(urls, "_digests", lambda keys: np.array([len(k) for k in keys], np.uint64))
    urls.DigestArray.write({"aa": "allow", "bb": "block", "c": "allow"}, tmp_path, "t")
    array = urls.DigestArray(tmp_path, "t")
    assert isinstance(array.bytes, np.memmap) and array.find(["bb", "aa", "cc", "c", "dddd"]) == ["block", "allow", None, "allow", None]


def test_tables_of_rules_and_their_join(spark, monkeypatch):
    pages = spark.createDataFrame([(k, u, "old", "x") for k, u in enumerate([*URLS, URLS[4]])], "page_id long, url string, rule string, verdict string")
    rules = spark.createDataFrame(list(urls.RULES), "host string, path string, verdict string")
    hosts = spark.createDataFrame([(h,) for h in urls.BLOCKED_HOSTS] * 2, "host string")
    for most in (1000, 0):
        monkeypatch.setattr(urls, "MOST_RULES", most)
        got = urls.judge_urls(pages, rules=rules, blocked_hosts=hosts)
        rows = got.collect()
        assert len(rows) == len(URLS) + 1 and set(got.columns) == {"page_id", "url", "host", "path", "rule", "verdict"}
        for r in rows:
            assert (r.host, r.path, r.rule, r.verdict) == plain(r.url), r.url
