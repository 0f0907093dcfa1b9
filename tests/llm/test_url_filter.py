from pyspark.sql import functions as F

from tickloom.llm import url_filter
from tickloom.llm.queries import RULES
from tickloom.llm.url_filter import judge_urls

URLS = [
    None, "", "no scheme", "http://Example.ORG/es/x?q#f", "https://a.b.example.org/es", "https://example.org/es/", "http://example.org/en/123", "http://example.org/en/2", "http://x.com/fr/a", "http://x.com/de/a",
    "http://x.com/other", "http://com/de/", "http://notexample.org/es/", "http://example.org?x=/es/", "ftp://u:p@Host.net:80/A/B//?q=1", "http://host.net", "http://listed.net/page/", "https://LISTED.net/page?utm=1#x", "http://listed.net/Page", "x://a://b.org/",
]


def slow(url, listed):
    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        for c in "?#":
            path = path.split(c)[0]
        return rest[:cut].translate({c: c + 32 for c in range(65, 91)}), path

    host, path = split(url)
    fits = [r for r in RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    canon = {h + p.rstrip("/") for h, p in map(split, listed) if h}
    return host, path, rule, RULES[rule] if rule else "block" if host and host + path.rstrip("/") in canon else "allow"


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string")
    lists = [["http://listed.net/page", None, "no scheme", "http://listed.net/page/"], [], [f"http://h{i}.net/{i}" for i in range(300)] + ["http://host.net"]]
    for listed in lists:
        for most in (64 << 20, 0):  # 0: the filter is joined by a shuffle
            rows = judge_urls(pages, spark.createDataFrame([(u,) for u in listed], "url string"), RULES, broadcast_bytes=most).collect()
            assert len(rows) == 2 * len(URLS)
            for r in rows:
                assert (r.host, r.path, r.rule, r.verdict) == slow(URLS[r.page_id % len(URLS)], listed)
    assert judge_urls(pages.limit(0), pages.select("url"), RULES).collect() == []


def test_filter_holds_every_listed_url(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_LISTED", 10)
    listed = spark.range(3_000).select(F.concat(F.lit("http://h.net/"), F.col("id")).alias("url"))
    pages = listed.withColumn("page_id", F.monotonically_increasing_id())
    assert judge_urls(pages, listed, {}).where("verdict = 'allow'").count() == 0
