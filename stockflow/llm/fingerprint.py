"""Document fingerprints (operator 6): one-permutation MinHash in SQL functions.

A text's words (lower-cased A-Z, split at white space) form shingles of five
(fewer words: the whole sequence). Each shingle is hashed once, to 32 bits:
the high bits name one of ``BINS`` bins, the rest is its value, and a bin keeps
its smallest value. An empty bin borrows from a full one found by its own probe
sequence, a random permutation of the bins that is the same for all documents
(optimal densification: every empty bin chooses anew). The low ``BITS`` bits
of each bin are packed into longs, shown as hexadecimal text.

Two fingerprints agree in a bin if the bins drew the same shingle, or by
chance with probability C = 2^-BITS; the likeness is the share of agreeing
bins corrected for that, (share - C) / (1 - C), at least 0.

Everything is a Column expression on one row: no Python on the executors, no
shuffle for the fingerprint itself. Null and empty texts count as one shingle,
the empty one, so they are equal to each other. Texts of any length take part
whole. Repeated rows get equal fingerprints.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHINGLE, BINS, BITS = 5, 128, 4
VALUE_BITS = 25  # 7 bits of bin and 25 of value: a hash of 32 bits
EMPTY = (1 << VALUE_BITS) - 1
PER_LONG = 64 // BITS
#: Probes tried for all empty bins at once before the whole permutation is.
QUICK = 6
#: Rows of one chunk of neighbouring documents, and boundaries at most.
CHUNK_ROWS, CHUNKS_MOST = 1000, 1 << 14


def probes(seed: int = 6) -> list[list[int]]:
    """For each bin the order in which it looks for a full one: all others, shuffled."""
    r, out = random.Random(seed), []
    for b in range(BINS):
        others = [k for k in range(BINS) if k != b]
        r.shuffle(others)
        out.append(others)
    return out




def constant(values: list, kind: str) -> Column:
    """A table of numbers as one literal, which keeps plans small."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the packed fingerprint (array of longs) of column ``text``.

    Written as a chain of small columns so that none is computed twice.
    """
    words = F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _SPACE), lambda w: w != "")
    df = df.withColumn("__w", F.transform(words, lambda w: F.xxhash64(w)))
    last = F.greatest(F.size("__w") - SHINGLE, F.lit(0))
    word = lambda i, k: F.get("__w", i + k)  # noqa: E731  null past the end, which xxhash64 passes over
    low = (1 << (VALUE_BITS + BINS.bit_length() - 1)) - 1
    hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        *[word(i, k) for k in range(SHINGLE)]).bitwiseAND(F.lit(low)))
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), VALUE_BITS) + EMPTY)
    df = df.withColumn("__s", F.sort_array(F.concat(hashed, ends)))
    bin_of = lambda x: F.shiftright(x, VALUE_BITS)
    # each bin has its end mark, so the first of every bin, in order, is an array of BINS values
    first = F.filter("__s", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get("__s", i - 1))))
    df = df.withColumn("__m", F.transform(first, lambda x: x.bitwiseAND(F.lit(EMPTY))))
    full = df.withColumn("__f", F.filter("__m", lambda x: x != EMPTY))
    table = probes()
    quick = constant([row[:QUICK] for row in table], "array<array<int>>")
    whole = constant([row[QUICK:] for row in table], "array<array<int>>")
    found = lambda rows, b: F.get(F.filter(F.transform(
        F.get(rows, b), lambda p: F.get("__m", p)), lambda x: x != EMPTY), 0)
    dense = F.when(F.size("__f") == BINS, F.col("__m")).when(
        F.size("__f") == 1, F.array_repeat(F.get("__f", F.lit(0)), BINS)).otherwise(
        F.transform("__m", lambda x, b: F.when(x != EMPTY, x).otherwise(F.coalesce(found(quick, b), found(whole, b)))))
    full = full.withColumn("__d", dense)
    part = lambda g: F.aggregate(F.slice("__d", g * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"),
                                 lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))))
    packed = F.array(*[part(g) for g in range(BINS // PER_LONG)])
    return full.withColumn(out, packed).drop("__w", "__s", "__m", "__f", "__d")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "[ \\x09-\\x0D]+"


def hexadecimal(packed: Column) -> Column:
    """The packed longs as one string of lower-case hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.get(packed, F.lit(g))), 16, "0") for g in range(BINS // PER_LONG)]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1."""
    unlike = F.lit(0)
    for g in range(BINS // PER_LONG):
        x = F.get(a, F.lit(g)).bitwiseXOR(F.get(b, F.lit(g)))
        for shift in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(F.get(a, F.lit(g)).bitwiseXOR(F.get(b, F.lit(g))), shift))
        unlike = unlike + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0 ** -BITS
    return F.greatest((1 - unlike / BINS - chance) / (1 - chance), F.lit(0.0))


def chunk_bounds(docs: DataFrame) -> list[int]:
    """First ids of chunks of about CHUNK_ROWS rows, ascending, from a mergeable
    quantile sketch of all ids: at most CHUNKS_MOST numbers."""
    n = docs.count()
    chunks = min(CHUNKS_MOST, max(1, n // CHUNK_ROWS))
    if chunks < 2:
        return []
    at = [k / chunks for k in range(1, chunks)]
    found = docs.agg(F.percentile_approx("doc_id", at, 10 * chunks).alias("q")).first()["q"]
    return sorted(set(found or []))


def with_next(docs: DataFrame, carried: list[str], prefix: str = "next_") -> DataFrame:
    """Each row with the ``carried`` columns of the next one in ascending doc_id.

    After the last comes the first. Null ids come first; equal ids are
    ordered by the hash of their text. Chunks of neighbouring ids are dealt to
    tasks by one shuffle; the first row of each chunk also goes to the chunk
    before as its end, so nothing else has to meet.
    """
    bounds, ident = chunk_bounds(docs), F.col("doc_id")
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[::step]
    fine = [bounds[k:k + step] for k in range(0, len(bounds), step)]
    if bounds:
        table = constant(fine, "array<array<long>>")
        at = F.size(F.filter(constant(coarse, "array<long>"), lambda b: b <= ident))
        inner = F.size(F.filter(F.get(table, at - 1), lambda b: b <= ident))
        chunk = F.when(ident.isNull() | (at == 0), F.lit(0)).otherwise((at - 1) * step + inner)
    else:
        chunk = F.lit(0)
    low = docs.agg(F.min("doc_id").alias("m"), F.max(F.col("doc_id").isNull()).alias("z")).first()
    is_low = ident.isNull() if low["z"] else ident.eqNullSafe(F.lit(low["m"]).cast("long"))
    copy = lambda to, kind: F.struct(to.cast("int").alias("chunk"), F.lit(kind).alias("kind"))
    opens = F.array_contains(F.get(table, F.floor((F.col("__c") - 1) / step).cast("int")), ident) if bounds else F.lit(False)
    dealt = docs.withColumn("__c", chunk.cast("int"))
    copies = F.concat(F.array(copy(F.col("__c"), 0)),
                      F.when(F.coalesce(opens, F.lit(False)), F.array(copy(F.col("__c") - 1, 1))).otherwise(F.array()),
                      F.when(is_low, F.array(copy(F.lit(len(bounds)), 2))).otherwise(F.array()))
    dealt = dealt.withColumn("__t", F.xxhash64("text")).select(
        *docs.columns, "__t", F.inline(copies).alias("__chunk", "__kind"))
    # plain columns in the window and one select for all of it: one exchange carries the texts
    w = Window.partitionBy("__chunk").orderBy("__kind", F.col("doc_id").asc_nulls_first(), "__t")
    out = dealt.select(*docs.columns, "__kind", *[F.lead(c).over(w).alias(prefix + c) for c in carried])
    return out.filter(F.col("__kind") == 0).drop("__kind")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with likenesses.

    The edited text ends in the beginning of the next document instead of
    its own second half.
    """
    own = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(with_fingerprint(own, "text", "fp"), ["text", "fp"])
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    out = own.withColumn("n_chars", size.cast("long")).withColumn("edited", edited)
    out = with_fingerprint(out.drop("text", "next_text"), "edited", "efp")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      hexadecimal(F.col("fp")).alias("fingerprint"), hexadecimal(F.col("efp")).alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
                      likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
