import random

import pytest

from reconlake.llm import url_filter
from reconlake.llm.queries import URL_RULES
from reconlake.llm.url_filter import judge_urls, rules_table


def slow(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        raw, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("most", [100_000, 0])  # broadcast, and joined by shuffle
def test_like_trying_every_rule(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_BROADCAST_RULES", most)
    rng = random.Random(14)
    hosts = ["example.org", "EXAMPLE.org", "a.b.example.org", "notexample.org", "org", "com", "x..com", ".com", "com.", "É.com", "a.com:80", "u@b.com"]
    urls = [None, "", "example.org/es/", "://", "http://", "http://a://b.org/", "http://org?x/", "x://example.org\n/es/a", "http://com/de/" + "z" * 5000]
    urls += [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/es', '/en/1', '/en/12?x=/es/', '/fr/a#b', '/de/', '?q', '#/de/'])}" for _ in range(300)]
    rules = [*URL_RULES, ("allow", "b.example.org", "/es/"), ("block", "com", "/fr/"), ("block", "org", "")]
    pages = spark.createDataFrame([(i % 290, u, "h") for i, u in enumerate(urls)] + [(None, urls[20], "x")], "page_id long, url string, host string")
    got = judge_urls(pages, rules_table(spark, rules)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((r.page_id, *slow(r.url, rules))) for r in pages.collect())


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://A.org/x")], "page_id long, url string")
    none = rules_table(spark, URL_RULES).limit(0)
    assert tuple(judge_urls(pages, none, "block").first()) == (1, "a.org", "/x", None, "block")
    assert judge_urls(pages.limit(0), rules_table(spark, URL_RULES)).count() == 0
