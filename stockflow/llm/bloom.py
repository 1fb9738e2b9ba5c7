"""Blocked Bloom filters of bounded size over 64-bit hashes.

A filter is an array of blocks of ``WORDS`` 64-bit words; a key sets one bit in
each word of one block. Executors combine the bits (a row for each block in
use reaches the driver, so at most ``most_bytes``), and tasks probe a broadcast copy.
With more keys than fit ``BITS_A_KEY`` bits each, more strangers pass; a key
is never refused.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, WORDS = 16, 8
BLOCK_BITS = WORDS * 64
MOST_BYTES = 32 << 20


def blocks_for(keys: int, most_bytes: int = MOST_BYTES) -> int:
    return max(1, min(-(-keys * BITS_A_KEY // BLOCK_BITS), most_bytes * 8 // BLOCK_BITS))


def build(rows: DataFrame, place: Column, bits: Column, blocks: int) -> np.ndarray:
    """The filter of all rows; ``place`` chooses a row's block, ``bits`` its bit in each word."""
    words = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("bits", 6 * i).bitwiseAND(63).cast("int")))
             .alias(f"w{i}") for i in range(WORDS)]
    found = (rows.select(F.pmod(place, F.lit(blocks)).alias("block"), bits.alias("bits")).groupBy("block").agg(*words)
             .toArrow())  # at most ``blocks`` rows
    out = np.zeros((blocks, WORDS), np.int64)
    for i in range(WORDS):
        out[found["block"].to_numpy(), i] = found[f"w{i}"].to_numpy()
    return out


def may_hold(table: np.ndarray, place: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each pair of hashes: may it be in the filter?"""
    blocks, at = place % len(table), np.ones(len(place), bool)
    for i in range(WORDS):
        at &= (table[blocks, i] >> ((bits >> (6 * i)) & 63)) & 1 == 1
    return at
