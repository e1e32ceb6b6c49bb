from __future__ import annotations

import random

from tallybridge.llm import url_filter
from tallybridge.llm.queries import URL_RULES


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "block"
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(h), len(p), v == "block", h + p, v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow" if host else "block")))


def test_urls(spark):
    pick = random.Random(1)
    rules = [
        *URL_RULES, ("block", "a.org", ""), ("allow", "a.org", "/x/y"), ("block", "a.org", "/x/y/"),
        ("allow", "b.a.org", "/"), ("block", "b.a.org", "/"), ("block", "com", "/fr/a"),
    ]
    hosts = ["a.org", "b.a.org", "ba.org", "ORG", "x.example.org", "Y.com", "com", "", "a..org", "é.com:80"]
    paths = ["", "/", "/x/y", "/x/yz", "/x/y/", "/fr/abc", "/fr", "/de/", "/es/1", "/en/12", "//x", "/É"]
    urls = [None, "", "no scheme", "://", "http:/a.org", "http://a.org://b"] + [
        f"http://{pick.choice(hosts)}{pick.choice(paths)}{pick.choice(['', '?q=/fr/', '#a', '#?', '?x#/de/'])}"
        for _ in range(400)
    ]
    pages = spark.createDataFrame(
        [(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, Host string, verdict int"
    )
    out = url_filter.judge_urls(pages, rules).collect()
    assert len(out) == len(urls)
    for row in out:
        assert (row.host, row.path, row.rule, row.verdict) == brute(urls[row.page_id], rules), urls[row.page_id]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
