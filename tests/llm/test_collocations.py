"""Collocations against a plain count, and the parse against the texts it came from."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stockflow.llm import collocations as C


def plain(rows, most=3, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        outer = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    outer[p[i:i + m]] = max(outer[p[i:i + m]], a)
        rows_ = []
        for p, a in cand.items():
            if outer[p] and 100 * outer[p] >= percent * a:
                continue
            s, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows_.append((-s, -a, " ".join(p).encode(), left, right))
        for r, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, 1, "x") for lang, t in rows], "text string, lang string, size int, phrase string")


def result(df):
    return sorted(map(tuple, df.collect()))


ROWS = ([("en", "The New York Times. New York, new york: of the of the of THE"), (None, "a b a b a b a b"), ("de", None), ("de", ""),
         ("de", " \t\n;.,"), ("fr", "ü ß 漢字 ü ß 漢字 \U0001f600"), ("en", "x " * 6000), ("en", "a b c d e " * 30),
         ("und", "a b a b a b")] + [("en", f"in spite of rain {k % 7} we go, in spite of it all")  for k in range(60)]
        + [("es", "uno dos tres cuatro cinco seis. uno dos")] * 40)


def test_matches_plain_count(spark):
    got = result(C.collocations(frame(spark, ROWS)))
    assert got == plain(ROWS) and got
    assert result(C.collocations(frame(spark, ROWS), most_words=5, least=3, percent=80, top=7)) == plain(ROWS, 5, 3, 80, 7)
    assert result(C.collocations(frame(spark, ROWS), most_words=2, least=1)) == plain(ROWS, 2, 1)


def test_counts_do_not_depend_on_the_cuts(spark):
    want = plain(ROWS, least=2)
    for period, longest in ((1, 1), (2, 3), (1 << 30, 5), (1 << 30, 1 << 30)):
        assert result(C.collocations(frame(spark, ROWS), least=2, period=period, longest=longest)) == want


def test_odd_tables(spark, odd, none):
    assert C.collocations(none).count() == 0
    got = result(C.collocations(odd, least=1))
    assert got == plain([(r.lang, r.text) for r in odd.collect()], least=1)


def test_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 2, "a b", 10**12 + 1), ("en", 1, "a", 10**12 + 3), ("en", 1, "b", 3 * 10**12 + 7)],
                                   "lang string, size int, phrase string, f long")
    a, left, right = 10**12 + 1, 10**12 + 3, 3 * 10**12 + 7
    assert C.scored(counts, 10, 3).first().score == 1000000 * a * a // (left * right)


def test_copies_meet_in_the_dictionary(spark):
    """A passage that repeats inside different texts gives mostly the same chunks."""
    body = " ".join(f"w{k * k % 997}" for k in range(3000))
    rows = [("en", f"start{k} " * (k % 5 + 1) + body) for k in range(50)]
    chunks = C.dictionary(frame(spark, rows), 2)
    assert chunks.filter(f"kind = {C.CHUNK}").count() < 3000 / C.PERIOD * 2 + 50 * 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab A.,\n\t\x0bü", max_size=60), min_size=1, max_size=4), st.integers(1, 4), st.integers(1, 6), st.integers(1, 9))
def test_each_start_is_owned_once(texts, window, period, longest):
    """The own parts of all chunks are the texts, and each chunk goes on by the next tokens, breaks at the end."""
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    tokens = [[t for t in C.normal(x.encode()).split(b" ") if t] for x in texts]
    full = [t for t in tokens if t]
    flat = [t for x in full for t in x + [C.BREAK] * window]
    if full:
        sizes = np.array([len(t) for t in full])
        starts = np.cumsum(sizes + window) - sizes - window
        hashes = np.array([zlib.crc32(t) for t in flat], np.uint32)
        first, end, text = C.own_parts(hashes, starts, starts + sizes, window, period, longest)
        assert [[t for i, j, k in zip(first, end, text) if k == n for t in flat[i:j]] for n in range(len(full))] == full
        chunks = Counter(b" ".join(flat[i:j + window]).decode() for i, j in zip(first, end))
    else:
        chunks = Counter()
    rows = [r for b in C._parser(window, period, longest)([batch]) for r in b.to_pylist()]
    assert {r["body"]: r["times"] for r in rows if r["kind"] == C.CHUNK} == chunks
    assert ({r["body"]: r["times"] for r in rows if r["kind"] == C.WORD}
            == Counter(t.decode() for x in full for t in x if t != C.BREAK))
