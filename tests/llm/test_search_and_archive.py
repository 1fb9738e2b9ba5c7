"""Nearest neighbours, archives, the pipeline and the registered queries."""

import base64
import hashlib

import numpy as np
import pytest

from stockflow.llm import ann, warc
from stockflow.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"


def brute(rows, k=10, every=100):
    good = [(i, n, np.array(v, float)) for n, (i, v) in enumerate(rows)
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [g for g in good if len(g[2]) == 4] if len(rows) < 200 else good
    out = []
    for i, n, v in good:
        if i is not None and i % every == 0:
            d = sorted((float(np.sqrt(((w - v) ** 2).sum())), j is None, j or 0) for j, m, w in good if m != n)[:k]
            out += [(i, r + 1, None if none else j, round(s, 9)) for r, (s, none, j) in enumerate(d)]
    return sorted(out, key=str)


@pytest.mark.parametrize("factor", [1.0, ann.FACTOR])
def test_neighbours_on_table(spark, factor):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    got = ann.nearest(table, factor=factor, shard_points=60).collect()
    want = brute([tuple(r) for r in table.collect()], every=100)
    mine = sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got), key=str)
    if factor == 1.0:
        assert mine == want
    hits = len({(q, v) for q, _, v, _ in mine} & {(q, v) for q, _, v, _ in want})
    assert hits >= 0.9 * len(want)


def test_neighbours_odd(spark):
    big = (1 << 60) + 100 - (1 << 60) % 100
    rows = [(0, [1.0, 2, 3, 4]), (100, [1.0, 2, 3, 4]), (100, [1.0, 2, 3, 4]), (None, [1.0, 2, 3, 5]), (big, [0.0, 1, 0, 0]),
            (big + 1, [0.0, 1, 0, 1]), (3, [0.0, 0, 0, 0]), (4, None), (5, []), (6, [1.0, None, 2, 3]), (7, [float("nan"), 1, 2, 3]),
            (8, [float("inf"), 1, 2, 3]), (9, [1.0, 2]), (200, [5.0, 5, 5, 5])]
    rows += [(1000 + k, [9.0, 9, 9, 9]) for k in range(40)]
    df = spark.createDataFrame(
        [(i, v and [None if x is None else float(x) for x in v], "x") for i, v in rows], "vec_id long, embedding array<double>, qid string")
    got = sorted(((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(df).collect()), key=str)
    assert got == brute(rows)
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.filter("vec_id = 0")).count() == 0  # no other row


def plain_pages(rows):
    low = {}
    for i, _, h in rows:
        if i is not None:
            low[h or ""] = min(i, low.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw, first = (h or "").encode(), low.get(h or "")
        revisit = first is not None and i != first
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response",
                    first if revisit else None))
    return sorted(out, key=str)


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "files_of", lambda n: 4)
    big = 1 << 60
    rows = [(k, f"http://a{k % 7}.example.com/p{k}?q={k}#f", f"<p>{k % 40}</p>") for k in range(300)]
    rows += [(900, None, None), (901, "", ""), (None, "http://x.org", "<p>1</p>"), (None, "http://x.org", "only"), (big + 1, "not a url\r\n", "é"),
             (902, "http://[bad", "y" * 300_000), (5, "http://a5.example.com/p5?q=5#f", "<p>5</p>"), (big, "https://EX.com:443/", "é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, key int")
    got = sorted((tuple(r) for r in warc.archive_round_trip(df).collect()), key=str)
    assert got == plain_pages(rows)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_index_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    monkeypatch.setattr(warc, "files_of", lambda n: 3)
    keys = sorted([f"com,x)/{k:03d}" for k in range(120)] + ["com,x)/050"] * 30)
    df = spark.createDataFrame([(k, f"f{n % 3}", n, 1) for n, k in enumerate(keys)], "key string, file string, at long, length long")
    files = warc.build_index(warc.materialize(df, "captures"), str(tmp_path))
    ask = spark.createDataFrame([(k,) for k in ["com,x)/000", "com,x)/050", "com,x)/119", "com,x)/0505", "a", "z"]], "key string")
    got = sorted((r.key, r.at) for r in warc.look_up(ask, str(tmp_path), files).collect())
    assert got == sorted((k, n) for n, k in enumerate(keys) if k in ("com,x)/000", "com,x)/050", "com,x)/119"))


def test_url_keys():
    assert warc.url_key("http://a.Example.com:80/x?y#z") == "com,example,a)/x?y"
    assert warc.url_key("https://b.org:8443") == "org,b:8443)/"
    assert warc.url_key(None) == "" and warc.url_key("no host") == "no%20host"


def test_pipeline_stages(spark, odd, none, tmp_path):
    import corpus_pipeline as cp
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (8, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns, name
            assert out.count() >= 0
    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]


def test_pipeline_run(spark):
    import corpus_pipeline as cp
    rows = cp.run(spark, "/root/testdata/sf0.001")
    used = rows.filter("bin is not null").groupBy("shard", "bin").sum("n_words").collect()
    assert used and max(r[2] for r in used) <= 2048


def test_registry():
    assert {n.split("_")[0] for n in REGISTRY} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
