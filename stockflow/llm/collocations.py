"""Phrase collocation mining (operator 13) by prefix-free parsing.

Parsing. The words of a text, with a break where punctuation or a line end
stands, are cut at triggers: a window of ``most_words - 1`` tokens whose hash is
divisible by ``PERIOD`` begins a chunk, and the chunk ends with the next trigger
window, so neighbouring chunks overlap by exactly that window. The cuts depend
on the words alone, so passages that repeat give the same chunks again; the
distinct chunks with their frequencies are the dictionary, and it alone is
read on. Where no trigger comes for ``LONGEST`` tokens a chunk ends all the
same. After the last token stand as many breaks as a window has tokens.

Counting. Each distinct chunk's n-grams are counted once, weighted by the
chunk's frequency, shorter ones first: an n-gram can only be frequent if the
n-grams of one word less at its two ends are, so those that a blocked Bloom
filter of the frequent shorter ones refuses are left out before the shuffle
(exact: the filter refuses no frequent one; its size is bounded, and a full
filter leaves out less). An n-gram belongs to the chunk in whose own part (all but the
final window) it starts, so what lies in an overlap is counted once, and every
n-gram lies whole in the chunk that owns it. Both steps sum inside the task
before they shuffle, so a line or phrase that fills a third of the corpus is one
row from each task.

Scoring. Counts of at least ``least`` occurrences (all that a candidate and its
parts can have) are joined with the parts of each cut; parts like "the" that
stand in very many candidates are broadcast (``join_hot_key``). Scores are exact
in decimals of 38 digits while an n-gram occurs less than 10^15 times. The first
``top`` of a language come from the first ``top`` of each of ``SALTS`` shares of
its candidates.

Null texts are empty, a null language is ``und``. Empty texts and texts of
breaks only add nothing. Repeated rows count each time. An empty table gives no
row. Extra columns are ignored. Very long texts are parsed whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockflow.llm import bloom
from stockflow.llm.common import join_hot_key, materialize

PERIOD, LONGEST, SALTS = 16, 512, 1000
#: Distinct chunks and words that a task holds before it passes them on, and
#: words of the dictionary that it counts at a time.
FLUSH_CHUNKS, FLUSH_WORDS = 100_000, 1_000_000
BREAK = b"\n"
_SPLIT = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = re.compile(b"  +")
CHUNK, WORD = 0, 1
Batches = Iterator[pa.RecordBatch]


def normal(text: bytes | None) -> bytes:
    """The words in lower case in order, and a BREAK for each separator of pieces, between single spaces."""
    return _SPACES.sub(b" ", (text or b"").translate(_SPLIT).replace(BREAK, b" \n ")).strip(b" ")


def own_parts(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, period: int,
              longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each chunk's own part begins and ends, and its text. ``hashes`` has a
    32-bit number for each token; text k has the tokens from ``starts[k]`` to
    ``ends[k]`` (at least one)."""
    mixed = np.zeros(max(len(hashes) - window + 1, 0), np.uint64)
    for k in range(window):
        mixed = (mixed + hashes[k:k + len(mixed)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero((mixed >> np.uint64(33)) % np.uint64(period) == 0)
    text = np.searchsorted(starts, at, "right") - 1
    at = at[(at > starts[text]) & (at + window <= ends[text])]
    begin = np.sort(np.concatenate([starts, at]))
    text = np.searchsorted(starts, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], len(hashes)), ends[text])
    parts = -(-(end - begin) // longest)  # a part without trigger for long is cut all the same
    which = np.repeat(np.arange(len(begin)), parts)
    first = begin[which] + longest * (np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts))
    return first, np.minimum(first + longest, end[which]), text[which]


def _coded(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = tokens.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct key and the sum of its weights."""
    group, distinct = pd.factorize(keys)
    first, total = np.empty(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    first[group[::-1]] = np.arange(len(keys))[::-1]
    np.add.at(total, group, weights)
    return first, total


def _parser(window: int, period: int, longest: int):
    pad = b" ".join([BREAK] * window)

    def parse(batches: Batches) -> Batches:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(found)
            rows = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([k[2] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())]
            found.clear()
            return pa.RecordBatch.from_arrays(rows, names=["lang", "kind", "body", "times"])

        for b in batches:
            texts = [normal(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            langs = [lang for lang, t in zip(b.column("lang").to_pylist(), texts) if t]
            texts = [t for t in texts if t]
            if not texts:
                continue
            data = b" ".join([t + b" " + pad for t in texts])
            sizes = np.array([t.count(b" ") + 1 for t in texts])
            starts = np.cumsum(sizes + window) - sizes - window
            codes, words = _coded(pc.split_pattern(pa.array([data], pa.binary()), b" ").flatten())
            names = words.to_pylist()
            hashes = np.fromiter(map(zlib.crc32, names), np.uint32, len(names))[codes]
            offsets = np.append(0, np.cumsum(pc.binary_length(words).to_numpy()[codes] + 1)).tolist()
            first, end, text = own_parts(hashes, starts, starts + sizes, window, period, longest)
            for i, j, k in zip(first.tolist(), end.tolist(), text.tolist()):
                found[langs[k], CHUNK, data[offsets[i]:offsets[j + window] - 1]] += 1
                if len(found) >= FLUSH_CHUNKS:
                    yield out()
            lang, spoken = _coded(pa.array(langs, pa.string()))
            own = np.repeat(lang, sizes + window) * len(names) + codes
            own = own[np.array([w != BREAK for w in names])[codes]]
            at, total = _summed(own, np.ones(len(own), np.int64))
            for k, n in zip(own[at].tolist(), total.tolist()):
                found[spoken[k // len(names)].as_py(), WORD, names[k % len(names)]] += n
            if len(found) >= FLUSH_CHUNKS:
                yield out()
        yield out()

    return parse


def dictionary(docs: DataFrame, window: int, text_col: str = "text", lang_col: str = "lang",
               period: int = PERIOD, longest: int = LONGEST) -> DataFrame:
    """(lang, kind, body, times): the distinct chunks of all texts (tokens between
    single spaces), and the distinct words of their own parts."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _totals(rows.mapInArrow(_parser(window, period, longest), "lang string, kind int, body string, times long"),
                   ["lang", "kind", "body"], "times")


def _totals(rows: DataFrame, key: list[str], out: str) -> DataFrame:
    """Sums of rows that are already sums of a task's share: summing again before the shuffle would save nothing."""
    return rows.repartition(*key).groupBy(*key).agg(F.sum("times").alias(out))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _hashes(words: list[bytes | str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of all but its last word and that word's."""
    return _mix(h * np.uint64(0xD6E8FEB86659FD93) + word)


def _grams(langs: pa.Array, chunks: pa.Array, times: np.ndarray, window: int, size: int, frequent: np.ndarray) -> pa.RecordBatch:
    """Weighted counts of the n-grams of one size that distinct chunks own and whose ends may be frequent."""
    split = pc.split_pattern(chunks.cast(pa.binary()), " ")
    sizes = np.diff(split.offsets.to_numpy())
    codes, words = _coded(split.flatten())
    names, n = words.to_pylist(), len(codes)
    lang, spoken = _coded(langs)
    word = np.array([w != BREAK for w in names])[codes]
    good = word & (np.arange(n) < np.repeat(np.cumsum(sizes), sizes) - window)  # own starts
    by_word = _mix(_hashes(names)[codes] ^ np.repeat(_hashes(spoken.to_pylist())[lang], sizes))
    h = by_word
    for k in range(1, size):  # an own start plus the window stays inside its chunk
        good[:n - k] &= word[k:]
        h = h if k == size - 1 else _extended(h[:-1], by_word[k:])
    may = bloom.may_hold(frequent, *_places(h))
    good[:len(may) - 1] &= may[:-1] & may[1:]
    at = np.flatnonzero(good)
    rank = np.repeat(lang, sizes)[at]
    for k in range(size):
        rank = pd.factorize(rank)[0] * len(names) + codes[at + k]
    first, total = _summed(rank, np.repeat(times, sizes)[at])
    starts = at[first]
    phrase = pc.binary_join_element_wise(*(words.take(pa.array(codes[starts + k])) for k in range(size)), b" ").cast(pa.string())
    return pa.RecordBatch.from_arrays([spoken.take(pa.array(np.repeat(lang, sizes)[starts])), phrase, pa.array(total)],
                                      names=["lang", "phrase", "times"])


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(1)).astype(np.int64), _mix(h).astype(np.int64)


def _counter(window: int, size: int, frequent):
    def count(batches: Batches) -> Batches:
        held, words = [], 0

        def grams() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lang, body, times = (t.column(c).chunk(0) for c in ("lang", "body", "times"))
            return _grams(lang, body, times.to_numpy(), window, size, frequent.value)

        for b in batches:
            if b.num_rows:
                held.append(b)
                words += pc.sum(pc.count_substring(b.column("body"), " ")).as_py() + b.num_rows
            if words >= FLUSH_WORDS:
                yield grams()
                words = 0
        if held:
            yield grams()

    return count


def _phrase_hashes(batches: Batches) -> Batches:
    for b in batches:
        spoken = _hashes(b.column("lang").to_pylist())
        h = np.zeros(b.num_rows, np.uint64)
        for i, phrase in enumerate(b.column("phrase").to_pylist()):
            by_word = _mix(_hashes(phrase.split(" ")) ^ spoken[i])
            h[i:i + 1] = by_word[:1]
            for k in range(1, len(by_word)):
                h[i:i + 1] = _extended(h[i:i + 1], by_word[k:k + 1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _places(h)], names=["place", "bits"])


def frequent_filter(counts: DataFrame):
    """Broadcast blocked Bloom filter of the phrases of ``counts``."""
    rows = counts.select("lang", "phrase").mapInArrow(_phrase_hashes, "place long, bits long")
    table = bloom.build(rows, F.col("place"), F.col("bits"), bloom.blocks_for(counts.count()))
    return counts.sparkSession.sparkContext.broadcast(table)


def frequent_ngrams(parsed: DataFrame, window: int, least: int) -> DataFrame:
    """(lang, size, phrase, f) of all n-grams up to ``window + 1`` words that
    occur ``least`` times; size 0, phrase '', counts all words of a language."""
    words, chunks = parsed.filter(F.col("kind") == WORD), parsed.filter(F.col("kind") == CHUNK).drop("kind")
    total = words.groupBy("lang").agg(F.sum("times").alias("f")).select("lang", F.lit(0).alias("size"), F.lit("").alias("phrase"), "f")
    level = words.filter(F.col("times") >= least).select("lang", F.lit(1).alias("size"), F.col("body").alias("phrase"), F.col("times").alias("f"))
    levels = [total, level]
    for size in range(2, window + 2):
        counted = chunks.mapInArrow(_counter(window, size, frequent_filter(level)), "lang string, phrase string, times long")
        level = materialize(_totals(counted, ["lang", "phrase"], "f").filter(F.col("f") >= least)
                            .select("lang", F.lit(size).alias("size"), "phrase", "f"), f"level_{size}")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def _key(part):
    return F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), part)


def scored(counts: DataFrame, least: int, most_words: int) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of each candidate, at its lowest-scoring cut."""
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    found = counts.filter((F.col("size") > 1) & (F.col("f") >= least))
    words = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"),
                        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = materialize(cuts.select("lang", "phrase", "size", "a", "k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.slice("words", F.lit(1), F.col("k")).alias("w")),
        F.struct(F.lit(1).alias("side"), F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("w")))).alias("s"))
        .select("lang", "phrase", "size", "a", "k", "s.side", _key(F.array_join("s.w", " ")).alias("part")), "cuts")
    uses = sides.groupBy("part").agg(F.count("*").alias("uses"))
    values = uses.join(counts.filter("size between 1 and %d" % (most_words - 1)).select(_key(F.col("phrase")).alias("part"), "f"), "part")
    both = (join_hot_key(sides, values, "part", "uses", sides.count()).repartition("lang", "phrase")
            .groupBy("lang", "phrase", "size", "a", "k")
            .agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")))
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a")), exact("l") * exact("r"))
    return (both.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "size", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
            .select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score"))


def without_parts(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that stand in no longer candidate with at least ``percent`` % of their occurrences."""
    n = F.col("size")
    longer = candidates.filter(n > 2).withColumn("words", F.split("phrase", " "))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(
        F.sequence(F.lit(1), n - m + 1), lambda s: F.array_join(F.slice("words", s, m), " "))))
    inside = (longer.select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("outer"))
              .groupBy("lang", "phrase").agg(F.max("outer").alias("outer")))
    return (candidates.join(inside, ["lang", "phrase"], "left")
            .filter(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * percent)).drop("outer"))


def collocations(docs: DataFrame, most_words: int = 3, least: int = 10, percent: int = 50, top: int = 2000,
                 period: int = PERIOD, longest: int = LONGEST) -> DataFrame:
    """The best phrases of two to ``most_words`` words of each language:
    lang, rank, phrase, a, l, r, n, score."""
    if most_words < 2:
        raise ValueError("phrases have at least two words")
    window = most_words - 1
    counts = frequent_ngrams(materialize(dictionary(docs, window, period=period, longest=longest), "dictionary", "zstd"), window, least)
    kept = without_parts(materialize(scored(counts, least, most_words), "candidates"), percent)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = (kept.withColumn("share", share)
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best)))
             .filter(F.col("rank") <= top))
    ranked = (first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
              .filter(F.col("rank") <= top))
    words = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return (ranked.join(words, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
