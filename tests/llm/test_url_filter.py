import random
import re

import pytest
from pyspark.sql import functions as F

from epilens.llm import url_filter
from epilens.llm.queries import URL_RULES

LOWER = str.maketrans(url_filter.UPPER, url_filter.UPPER.lower())


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOWER)
    fits = [
        (len(h) + len(p), len(h), v == "block", h + p, v)
        for v, h, p in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


URLS = [
    "http://Example.ORG/es/1", "https://a.example.org/en/17?q=1", "https://example.org/en/2", "http://example.org",
    "http://notexample.org/es/", "http://x.com/de/a#b", "http://x.com/fr/", "http://x.com/en/", "x.com/de/", None, "",
    "://", "http://", "http:///de/", "http://org/", "http://com/de/x/http://a.org/y", "http://com?/de/", "a\nb://c.com/de/\nz",
    "http://u:p@h.com:80/de/", "http://É.com/de/é", "http://a..com/de/", "http://.org/", "http://ORGé/",
]


def test_contract_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("_row", F.lit(1))
    got = url_filter.judge_urls(df, url_filter.rules_frame(spark, URL_RULES))
    assert got.columns == ["page_id", "url", "_row", "host", "path", "rule", "verdict"]
    want = [(i, *brute(u, URL_RULES)) for i, u, _ in rows]
    rows = got.select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_random_rules(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", broadcast)
    r = random.Random(4)
    hosts = ["a.b.c", "b.c", "c", "x.c", "b", "a.b"]
    paths = ["", "/", "/p", "/p/q", "/pq/"]
    rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for h, p in ((r.choice(hosts), r.choice(paths)) for _ in range(14))}.values())
    rows = [(i, f"http://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', 'z', '?/p', '#'])}") for i in range(300)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rules_frame(spark, rules), default="block")
    assert sorted(tuple(x) for x in got.drop("url").collect()) == sorted((i, *brute(u, rules, "block")) for i, u in rows)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = url_filter.rules_frame(spark, [])
    assert [r.verdict for r in url_filter.judge_urls(pages, none).collect()] == ["allow"]
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark, URL_RULES)).count() == 0
