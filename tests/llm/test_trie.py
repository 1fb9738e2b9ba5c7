"""Prefix trie against a plain version; the double array against a set of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stockflow.llm.trie import DoubleArray, conversation_trie


def plain(rows, every=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    nodes, ends = defaultdict(set), defaultdict(set)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % every) * (1 if c >= 0 else -1)
        seq = own.get(base, [])[:h] + ts[h:]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].add(c)
        ends[tuple(seq)].add(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), leaves[p], saved[p], digest))
    return sorted(out)


def result(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                  for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, key string, depth int")


def some(seed, convs=120, words=3, most=9):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        rows += [(c * 7 - 200, t, r.choice(["user", "assistant"]), "ü" * r.randrange(words)) for t in range(r.randrange(1, most))]
    r.shuffle(rows)
    return rows


def test_matches_plain_version(spark):
    rows = some(1) + [(5, None, None, None), (5, None, "user", ""), (5, 3, "a", "tie"), (5, 3, "a", "tie"), (5, 3, "b", "tie"), (None, 1, "u", "lost"),
                      (1 << 60, 0, "user", "x" * 5000), ((1 << 60) + 1, 0, "user", "\U0001f600")]
    want = plain(rows)
    assert result(conversation_trie(frame(spark, rows))) == want
    for levels, shard in ((2, 3), (1, 1), (3, 1000)):
        assert result(conversation_trie(frame(spark, rows), levels=levels, shard=shard)) == want


def test_copies_and_one_long_conversation(spark):
    copies = [(c, t, "user", f"same {t}") for c in range(10_000, 10_300) for t in range(3)]
    long = [(7, t, "user", "again") for t in range(700)] + [(9, t, "user", "again" if t < 500 else "new") for t in range(600)]
    rows = copies + long + some(2, 30)
    assert result(conversation_trie(frame(spark, rows), shard=50)) == plain(rows)


def test_only_turnless_and_empty(spark):
    from zlib import crc32
    c = next(c for c in range(101, 200) if crc32(str(c).encode()) % 6 >= 1)
    assert result(conversation_trie(frame(spark, [(c, 0, "u", "gone")]))) == plain([(c, 0, "u", "gone")])
    assert conversation_trie(frame(spark, []).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), max_size=5), min_size=1, max_size=30))
def test_double_array_holds_exactly_the_prefixes(rows):
    rows = sorted(rows)
    trie = DoubleArray(rows)
    prefixes = {tuple(r[:d]) for r in rows for d in range(len(r) + 1)}
    states = {(): 0}
    for p in sorted(prefixes, key=len):
        for c in range(14):
            to = int(trie.step(np.array([states[p]]), np.array([c]))[0])
            assert (to >= 0) == ((*p, c) in prefixes)
            if to >= 0:
                states[(*p, c)] = to
    assert len(set(states.values())) == len(states)
