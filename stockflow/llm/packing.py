"""Best-fit packing (operator 1) into fixed-length sequences under conflicts.

Each document is a run of words. Whole multiples of the capacity fill
sequences (bins) of their own; the remainders are packed best-fit, longest
first. A bin holds at most one piece of a source and at most one piece of a
cluster of duplicates: it carries a bitmap of each. Bins are ordered by what
they have left. The successor search starts at the smallest residual that
fits and goes on to larger ones until it meets a compatible bin, which is then
the tightest one; levels whose bins all hold the piece's source are stepped
over by counting. Only if none is compatible is a new bin opened.

Pieces are dealt by a hash into shards of about ``SHARD_PIECES`` pieces,
however the sources and clusters are distributed, and each shard is packed on
its own: work and memory of a task are bounded, results do not depend on the
order of rows, and copies in different shards can never share a bin.

Duplicates are told by a 64-bit hash of the whole text (a collision only keeps
two documents apart). Null and empty texts have no words, go into no bin and
are returned with null bin. Null sources count as one source. Repeated rows
are packed as often as they occur, in different bins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockflow.llm.mixing import words

CAPACITY, SHARD_PIECES = 2048, 4096


class Bins:
    """Open bins of one shard, ordered by residual, with conflict bitmaps."""

    def __init__(self, capacity: int, sources: int):
        self.levels: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
        self.holding = np.zeros((sources, capacity + 1), np.int32)
        self.open = np.zeros(capacity + 1, np.int32)
        self.capacity, self.number = capacity, 0

    def _find(self, size: int, source: int, cluster: int):
        """(residual, bitmaps) of the tightest bin that fits without conflict, or None."""
        free = np.nonzero(self.holding[source, size:] < self.open[size:])[0]
        bit = 1 << source
        for r in (free + size).tolist():
            for held in self.levels[r]:
                if not (held[0] & bit or held[1] & cluster):
                    return r, held
        return None

    def _move(self, held: tuple[int, int], level: int, by: int) -> None:
        self.open[level] += by
        bits = held[0]
        while bits:
            low = bits & -bits
            self.holding[low.bit_length() - 1, level] += by
            bits ^= low

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, words already in it) for a piece; ``cluster`` is a bitmap of one bit or none."""
        found = self._find(size, source, cluster)
        if found:
            left, held = found
            own = self.levels[left][held]
            number = own.pop()
            if not own:
                del self.levels[left][held]
            self._move(held, left, -1)
        else:
            left, held, number = self.capacity, (0, 0), self.number
            self.number += 1
        held = (held[0] | 1 << source, held[1] | cluster)
        if left - size:
            self.levels[left - size].setdefault(held, []).append(number)
            self._move(held, left - size, 1)
        return number, self.capacity - left


def _pack(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "tie"], ascending=[False, True], kind="stable").reset_index(drop=True)
        source = pd.factorize(rows["source"], use_na_sentinel=False)[0]
        codes = pd.factorize(rows["cluster"])[0]
        shared = np.nonzero(np.bincount(codes) > 1)[0]
        bit = dict(zip(shared.tolist(), range(shared.size)))
        bins = Bins(capacity, int(source.max()) + 1)
        put = [bins.put(n, s, 1 << bit[c] if c in bit else 0)
               for n, s, c in zip(rows["n_words"].tolist(), source.tolist(), codes.tolist())]
        rows["bin"], rows["bin_offset"] = np.array(put, np.int64).reshape(-1, 2).T
        return rows.drop(columns=["tie"])
    return pack


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece of ``docs(doc_id, source, text)``.

    Columns: doc_id, source, cluster, copy (of equal rows), piece, start and
    n_words (the words of the document it holds), shard and bin (null for a
    document without words), bin_offset (where in the bin it starts).
    """
    ident = docs.select("doc_id").schema[0].dataType
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster"),
                       words(F.col("text")).alias("size"))
    rows = slim.groupBy("doc_id", "source", "cluster", "size").agg(F.count("*").alias("n"))
    one = F.lit(1).cast("long")
    pieces = (rows.withColumn("copy", F.explode(F.sequence(one, F.col("n"))))
              .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
                  F.ceil(F.col("size") / capacity), one) - 1)))
              .withColumn("start", F.col("piece") * capacity)
              .withColumn("n_words", F.least(F.col("size") - F.col("start"), F.lit(capacity).cast("long"))))
    total = slim.agg(F.sum(F.greatest(F.ceil(F.col("size") / capacity), one)).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_pieces))
    tie = F.xxhash64("doc_id", "source", "cluster", "copy", "piece")
    cols = ["doc_id", "source", "cluster", "copy", "piece", "start", "n_words"]
    dealt = (pieces.filter(F.col("n_words") > 0).withColumn("tie", tie)
             .select(*cols, F.pmod("tie", F.lit(shards)).alias("shard"), "tie"))
    kind = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    schema = ", ".join(f"{c} {kind[c]}" for c in [*cols, "shard"]) + ", bin long, bin_offset long"
    packed = dealt.groupBy("shard").applyInPandas(_pack(capacity), schema)
    none = F.lit(None).cast("long")
    out = packed.unionByName(pieces.filter(F.col("n_words") == 0).select(
        *cols, none.alias("shard"), none.alias("bin"), none.alias("bin_offset")))
    return out.withColumn("doc_id", F.col("doc_id").cast(ident))  # as text so far: pandas would round a nullable long
