"""SimHash, mixing and packing against brute force, and their odd cases."""

import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from stockflow.llm import mixing, packing, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 3 and root[i] != root[j]:
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    low = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            low[root[k]] = min(d, low.get(root[k], d))
    return [(d, f"{prints[k]:016x}", low.get(root[k])) for k, (d, _) in enumerate(rows)]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def near_rows():
    words = [f"w{k}" for k in range(400)]
    rows = [(100 + k, " ".join([*words[:399], f"edit{k}"])) for k in range(30)]
    return rows + [(300 + k, " ".join(words[k:] + words[:k])) for k in range(20)] + [(90, rows[3][1])]


def test_components_match_brute_force(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in simhash.simhash_components(df).collect()), key=key)
    assert got == sorted(plain_components(rows), key=key)


def test_components_on_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in simhash.simhash_components(docs).collect()), key=key)
    assert got == sorted(plain_components([tuple(r) for r in docs.collect()]), key=key)


@pytest.mark.parametrize("points", [20, 60])
def test_shards_lose_no_link(spark, points):
    """Many small shards give the same components as all pairs."""
    import random
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(6)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = simhash.materialize(spark.createDataFrame([(p,) for p in signed], "fp long"), "nodes")
    edges = [tuple(x) for x in simhash.links(df, len(signed), shard_points=points).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in edges)

    def classes(pairs):
        root = {p: p for p in signed}
        for a, b in pairs:
            x, y = root[a], root[b]
            root = {k: x if v == y else v for k, v in root.items()} if x != y else root
        out = defaultdict(set)
        for k, v in root.items():
            out[v].add(k)
        return sorted(map(sorted, out.values()))
    want = [(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    assert classes(edges) == classes(want)


def test_visits_are_spread():
    """131,072 random fingerprints in 128 shards: no task holds more than four times the mean."""
    r = np.random.default_rng(7)
    points = np.unique(r.integers(0, 1 << 63, 131_072, dtype=np.int64))
    sample = points[r.permutation(points.size)[:128 * simhash.SAMPLE_PER_SHARD]]
    tree = simhash._top_tree(sample.view(np.uint64), 128)
    plan = simhash._task_plan(tree, sample.view(np.uint64), 128, 3)
    assert [f for f, _ in plan] == np.cumsum([0] + [t for _, t in plan[:-1]]).tolist() and max(t for _, t in plan) > 1
    rows = pd.concat(simhash._dealer(tree, plan, 3)(iter([pd.DataFrame({"fp": points})])))
    assert rows.loc[~rows["visits"], "fp"].nunique() == points.size
    load = rows.groupby("task").size()
    assert load.size == sum(t for _, t in plan) and load.max() < 4 * load.mean() and load.max() < 0.06 * points.size


def test_of_two_shards_one_visits():
    own = np.repeat(np.arange(40), 40), np.tile(np.arange(40), 40)
    meets = np.array([simhash._visits(np.array([a]), b)[0] for a, b in zip(*own)]).reshape(40, 40)
    assert not meets.diagonal().any() and (meets ^ meets.T)[~np.eye(40, dtype=bool)].all()
    assert 8 < meets.sum(1).min() and meets.sum(1).max() < 32


def test_keep_one(spark, odd, none):
    kept = simhash.keep_one_of_each(odd)
    assert kept.schema == odd.schema
    rows = kept.collect()
    classes = {c for _, _, c in plain_components([(r.doc_id, r.text) for r in odd.collect()])}
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(c for c in classes if c is not None)
    assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 7 for r in rows) == 1
    assert simhash.keep_one_of_each(none).count() == simhash.simhash_components(none).count() == 0


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not more:
            return {s: float(3 * sizes[s]) if s in capped else level * weight[s] for s in names}
        capped |= more


def check_mix(df):
    rows = mixing.mixture(df).collect()
    text = re.compile(r"[^\x20\x09-\x0D]+")
    docs = df.select("doc_id", "source", "text").collect()
    assert sorted(len(text.findall(d.text or "")) for d in docs) == sorted(r["size"] for r in rows)
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += len(text.findall(d.text or ""))
    want, by = plain_targets(sizes), defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by[round(r.target, 6), r.source_size].append(r)
    assert sorted((round(t, 3), sizes[s]) for s, t in want.items()) == sorted((round(t, 3), s) for t, s in by)
    return by


def test_mix_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (target, _), rows in check_mix(docs).items():
        assert abs(sum(r.taken for r in rows) - target) <= max(r["size"] for r in rows)
    assert sorted(mixing.mixture(docs).collect()) == sorted(mixing.mixture(docs).collect())


def test_mix_is_the_pareto_order(spark):
    """The sampled copies are a prefix of the documents in rank order, cut nearest to the target."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("source in ('src1','src2','src3')")
    plan = {r.m_source: r for r in mixing.source_plan(docs).collect()}
    sized = docs.withColumn("size", mixing.words(F.col("text"))).join(mixing.source_plan(docs), F.col("source") == F.col("m_source"))
    rank = mixing.pareto_rank((F.col("doc_id"), F.col("source"), F.col("text")), F.col("size"), mixing.SEED, mixing.default_importance)
    by = defaultdict(list)
    for r in sized.select("source", "size", rank.alias("rank")).collect():
        by[r.source].append((r.rank, r["size"]))
    for s, rows in by.items():
        runs, run = [(-1, 0)], 0
        for k, n in sorted(rows):
            run += n
            runs.append((k, run))
        past = next((i for i, (_, x) in enumerate(runs) if x > plan[s].m_part), None)
        if past is not None:
            best = min((abs(x - plan[s].m_part) for _, x in runs[past - 1:past + 1]))
            taken = sum(n for k, n in rows if k <= plan[s].m_cut)
            assert abs(taken - plan[s].m_part) == pytest.approx(best)


def test_mix_odd(odd, none):
    check_mix(odd)
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    copies = sum(r.copies for r in mixing.mixture(odd).collect())
    assert out.count() == copies
    assert mixing.mixture(none).count() == mixing.mixed_documents(none).count() == 0


def best_fit(items, capacity):
    """Best-fit decreasing by trying every bin."""
    bins = []
    for size, source, cluster in items:
        fit = [b for b in bins if b[0] >= size and source not in b[1] and cluster not in b[2]]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            b = [capacity, set(), set()]
            bins.append(b)
        b[0] -= size
        b[1].add(source)
        b[2].add(cluster)
    return sorted(b[0] for b in bins)


def test_bins_find_the_tightest():
    """With each piece's choice checked against all bins."""
    import random
    r = random.Random(1)
    bins, held = packing.Bins(50, 5), {}
    for _ in range(600):
        size, source, cluster = r.randint(1, 50), r.randrange(5), r.choice([0, 0, 1, 2, 4])
        fit = [50 - u for u, s, c in held.values() if 50 - u >= size and source not in s and not c & cluster]
        number, used = bins.put(size, source, cluster)
        if fit:
            assert 50 - used == min(fit)
        else:
            assert number not in held
        u, s, c = held.get(number, (0, frozenset(), 0))
        assert u == used
        held[number] = (u + size, s | {source}, c | cluster)


def check_packing(docs, capacity):
    rows = packing.pack_documents(docs, capacity).collect()
    text = re.compile(r"[^\x20\x09-\x0D]+")
    assert sum(r.n_words for r in rows) == sum(len(text.findall(d.text or "")) for d in docs.collect())
    bins = defaultdict(list)
    for r in rows:
        if r.n_words:
            bins[r.shard, r.bin].append(r)
        else:
            assert r.bin is None
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
        assert at <= capacity
        assert len({r.source for r in own}) == len(own) and len({r.cluster for r in own}) == len(own)
    return rows


def test_packing(spark, odd, none):
    check_packing(spark.read.parquet(f"{SF}/documents.parquet"), 2048)
    rows = check_packing(odd, 100)
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}  # ids above 2^53 beside a null
    assert len({(r.doc_id, r.copy) for r in rows if r.doc_id == 7}) == 2
    assert sum(r.doc_id == 8 for r in rows) == 60
    assert packing.pack_documents(none).count() == 0


def test_packing_is_best_fit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150")
    rows = [r for r in check_packing(docs, 1000) if r.n_words]
    used = defaultdict(int)
    for r in rows:
        used[r.shard, r.bin] += r.n_words
    import pandas as pd
    pdf = pd.DataFrame([(r.n_words, r.source, r.cluster) for r in rows], columns=["n", "s", "c"])
    waste = best_fit(sorted(pdf.itertuples(index=False, name=None), reverse=True), 1000)
    assert abs(len(used) - len(waste)) <= 2
