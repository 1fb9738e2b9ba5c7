"""URL filters (operator 11): rules by host and path, then a list of canonical URLs.

Rules. A rule (action, host, path) fits its host and all subdomains when the
url's path starts with the rule's path. The longest fitting rule wins (longest
host and path together; at equal length the longer host). Rules are policy
written by people: at most ``MOST_RULES``, more raise an error.

List. Urls that no rule decides are looked up, in canonical form, in a list of
any size. A blocked Bloom filter over the listed canonical urls (blocks of 512
bits: one bit in each of eight words) is probed by every row where it lies;
rows that the filter refuses are certainly not listed and are never shuffled.
Possible hits go to an exact hash join with the list, which removes the false
positives. The filter is broadcast, so its size has a fixed bound
(``bloom.MOST_BYTES``): a list too long for ``bloom.BITS_A_KEY`` bits per url within
that bound only makes more possible hits, never a wrong verdict. The exact join
spreads urls that occur very often (``join_hot_key``).

Canonical form: no scheme, user, default port, ``www.`` or fragment; host in
lower case without final dots; repeated slashes, ``/index.html`` and final
slashes of the path dropped; query parameters sorted, tracking ones dropped.

Null urls, and urls without ``://``, have empty host and path, fit no rule and
are never listed. Repeated rows are judged each. Empty tables and an empty list
give an empty result and no listed url. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.llm import bloom
from stockflow.llm.common import join_hot_key, materialize

MOST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Query parameters that only track a visit.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)(=|$)"


class Rule(NamedTuple):
    action: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """The form in which urls are listed; null for a null url or one without ``://``."""
    host = url_host(url)
    for found, put in ((r"(?s)^.*@", ""), (r":(80|443)?$", ""), (r"[.]+$", ""), (r"^www[.]", "")):
        host = F.regexp_replace(host, found, put)
    path = url_path(url)
    for found, put in ((r"/+", "/"), (r"/index[.](html?|php)$", "/"), (r"/$", "")):
        path = F.regexp_replace(path, found, put)
    query = F.regexp_extract(_rest(url), r"^[^?#]*[?]([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(_rest(url).isNotNull(), F.concat(host, path, tail))


def _rule_finder(rules: Sequence[Rule]):
    """Pandas function (host, path) -> place of the longest fitting rule, -1 for none."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are supported, longer lists belong in the url list")
    by_host: dict[str, list[tuple[int, int, str, int]]] = {}
    for k, r in enumerate(rules):
        by_host.setdefault(r.host, []).append((-len(r.host) - len(r.path), -len(r.host), r.path, k))
    for own in by_host.values():
        own.sort()

    def place(host: str, path: str) -> int:
        best, tail = None, host
        while tail:
            best = min([x for x in [next((x for x in by_host.get(tail, ()) if path.startswith(x[2])), None), best] if x],
                       default=None)
            tail = tail.partition(".")[2]
        return -1 if best is None else best[3]

    def find(host: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([place(h, p) for h, p in zip(host, path)], dtype="int32")

    return F.pandas_udf(find, "int")


def _hashes(canonical: Column) -> tuple[Column, Column]:
    return F.xxhash64(canonical), F.xxhash64(canonical, F.lit("bits"))


def _probe(spark, words: np.ndarray):
    """Pandas function (hash, bit hash) -> may the url be listed?"""
    shared = spark.sparkContext.broadcast(words)

    def may(h: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series(bloom.may_hold(shared.value, h.to_numpy(), bits.to_numpy()))

    return F.pandas_udf(may, "boolean")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow", on_list: str = "block",
               filter_bytes: int = bloom.MOST_BYTES) -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, canonical, listed.

    ``listed`` has one column of urls in any form. ``rule`` is the winning
    rule's host and path, ``verdict`` its action; without a rule ``on_list``
    for a listed canonical url, else ``default``. ``listed`` is null where a
    rule decided.
    """
    spark = pages.sparkSession
    known = materialize(listed.select(canonical_url(F.col(listed.columns[0])).alias("canonical"))
                        .filter("canonical is not null").distinct(), "listed")
    words = bloom.build(known, *_hashes(F.col("canonical")), bloom.blocks_for(known.count(), filter_bytes))
    may, find = _probe(spark, words), _rule_finder(rules)
    url = F.col(url_col)
    place = F.col("place") + 1
    names = F.array(*[F.lit(r.host + r.path) for r in rules], F.lit(None).cast("string"))
    actions = F.array(*[F.lit(r.action) for r in rules], F.lit(None).cast("string"))
    rows = (pages.select(F.col(id_col).alias(id_col), url_host(url).alias("host"), url_path(url).alias("path"),
                         canonical_url(url).alias("canonical"))
            .withColumn("place", find("host", "path")))
    ruled = F.col("place") >= 0
    seen = materialize(
        rows.withColumn("may", F.when(ruled | F.col("canonical").isNull(), F.lit(False)).otherwise(
            may(*(F.coalesce(h, F.lit(0)) for h in _hashes(F.col("canonical"))))))
        .select(id_col, "host", "path", "canonical", "may",
                F.when(ruled, F.element_at(names, place)).alias("rule"),
                F.when(ruled, F.element_at(actions, place)).alias("action")), "judged")
    certain, possible = seen.filter(~F.col("may")), seen.filter("may")
    uses = possible.groupBy("canonical").agg(F.count("*").alias("uses"))
    hits = uses.join(known, "canonical").withColumn("hit", F.lit(True))
    checked = join_hot_key(possible, hits, "canonical", "uses", possible.count())
    out = certain.withColumn("hit", F.lit(None).cast("boolean")).unionByName(checked)
    return out.select(id_col, "host", "path", "rule",
                      F.coalesce("action", F.when(F.col("hit"), F.lit(on_list)).otherwise(F.lit(default))).alias("verdict"),
                      "canonical", F.when(F.col("rule").isNull(), F.coalesce("hit", F.lit(False))).alias("listed"))
