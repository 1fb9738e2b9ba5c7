"""URL filter against a plain version and planted urls; the filter never refuses a listed url."""

import re

import numpy as np
from pyspark.sql import functions as F

from stockflow.llm import bloom, urls
from stockflow.llm.urls import Rule, judge_urls

RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
URLS = [None, "", "no scheme/x", "://", "http://", "http://EXAMPLE.org", "http://EXAMPLE.org/es/1", "http://a.b.example.org/en/12?x#y",
        "http://notexample.org/es/1", "https://x.com/fr/?a=http://y.org/", "https://x.com#/fr/", "http://com/de/", "http://comx/de/",
        "HTTP://U:p@www.Shop.net:80/a//b/index.html?b=2&utm_source=z&a=1#f", "https://shop.net/a/b/?a=1&b=2", "http://shop.net/a/b?a=1",
        "http://ü.net/ß漢", "a?b=http://late.org/q", "http://net./p/", "http://net/p"] + ["http://hot.net/p?utm_x=%d" % (k % 3) for k in range(400)]
LISTED = ["https://shop.net/a/b?a=1&b=2", "http://hot.net/p/", "http://net/p", None, "broken"]


def canonical(url):
    if url is None or "://" not in url:
        return None
    host, path, query = parts(url)
    host = re.sub(r"^www[.]", "", re.sub(r"[.]+$", "", re.sub(r":(80|443)?$", "", re.sub(r"(?s)^.*@", "", host))))
    path = re.sub(r"/$", "", re.sub(r"/index[.](html?|php)$", "/", re.sub(r"/+", "/", path)))
    kept = sorted(p for p in query.split("&") if p and not re.search(urls.TRACKING, p))
    return host + path + ("?" + "&".join(kept) if kept else "")


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0]
    rest, _, query = rest.partition("?")
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path, query


def plain(rows, listed):
    known = {canonical(u) for u in listed} - {None}
    out = []
    for i, u in rows:
        host, path, _ = parts(u)
        fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.host + r.path), default=None)
        on = canonical(u) in known
        out.append((i, host, path, best and best.host + best.path, best.action if best else "block" if on else "allow"))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=str)


def tables(spark):
    rows = [(None if k == 7 else k, u) for k, u in enumerate(URLS)]
    pages = spark.createDataFrame([(*r, "x", True, "y") for r in rows], "page_id long, url string, host string, may boolean, rule string")
    return rows, pages, spark.createDataFrame([(u,) for u in LISTED], "anything string")


def test_matches_plain_version(spark):
    rows, pages, listed = tables(spark)
    assert result(judge_urls(pages, RULES, listed)) == plain(rows, LISTED)
    assert result(judge_urls(pages, RULES, listed.limit(0))) == plain(rows, [])
    assert judge_urls(pages.limit(0), RULES, listed).count() == 0


def test_full_filter_stays_exact(spark):
    """A filter of one block lets nearly everything through: the exact join decides alone."""
    many = [f"http://many.net/{k}" for k in range(3000)]
    rows = [(k, u) for k, u in enumerate(many)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = judge_urls(pages, [], spark.createDataFrame([(u,) for u in many[::2]], "u string"), filter_bytes=64).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == set(range(0, 3000, 2))


def test_filter_refuses_most_and_never_a_listed_url(spark):
    n, blocks = 4000, bloom.blocks_for(4000)
    known = spark.range(n).select(F.concat(F.lit("a.net/"), "id").alias("c"))
    words = bloom.build(known, *urls._hashes(F.col("c")), blocks)
    assert words.shape == (blocks, bloom.WORDS)
    may = urls._probe(spark, words)
    probe = lambda df: df.select(may(*urls._hashes(F.col("c"))).alias("m")).filter("m").count()
    assert probe(known) == n
    assert probe(spark.range(20_000).select(F.concat(F.lit("b.net/"), "id").alias("c"))) < 20_000 * 0.02
    assert np.bitwise_count(words.view(np.uint64)).sum() <= n * bloom.WORDS


def test_rules_tie_and_bound(spark):
    pages = spark.createDataFrame([(1, "http://x.a.org/b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "u string")
    tie = [Rule("block", "org", "/b/c"), Rule("allow", "a.org", "/b")]  # eight characters less one each: 7 and 7
    assert judge_urls(pages, tie, none).first().rule == "a.org/b"
    try:
        judge_urls(pages, [Rule("block", f"h{k}.org", "/") for k in range(urls.MOST_RULES + 1)], none)
    except ValueError:
        return
    raise AssertionError("too many rules must raise")
