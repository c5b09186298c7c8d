"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0 to n - 1 in the order of (id, size, crc, hash of the
text).  A keyed Feistel network permutes the smallest domain of 2**(2k) numbers
that holds n; numbers that leave [0, n) walk on through the network until they
are back, so the result is a permutation of [0, n) that anyone can compute (and
invert) from the seed and n alone.  Shard is the permuted number modulo the shard
count, slot the quotient: shard sizes are at most one apart and slots gapless.

Plan: only the id and a few numbers of each row are range-partitioned and sorted;
the sorted rows are checkpointed, so that numbers never change if a task runs
again; a row's number is its partition's offset plus its place.  The driver sees
one count for each partition.  Equal rows are ranked by where they were read, so
that a group of them of any size still spreads over partitions.

Defined cases: null ids come first; null text has 0 bytes and crc 0; equal rows
get different slots; an empty table gives an empty result; incoming columns named
like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix

ROUNDS = 6
SEED = 20240229
OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def round_keys(seed: int) -> np.ndarray:
    return mix(np.uint64(seed) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def half_bits(n: int) -> int:
    """Bits of each half of the domain: the least k with 2**(2k) >= n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, k: int, keys) -> np.ndarray:
    shift, mask = np.uint64(k), np.uint64((1 << k) - 1)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (mix(right + key) & mask)
    return (left << shift) | right


def _inverse(x: np.ndarray, k: int, keys) -> np.ndarray:
    shift, mask = np.uint64(k), np.uint64((1 << k) - 1)
    left, right = x >> shift, x & mask
    for key in keys[::-1]:
        left, right = right ^ (mix(left + key) & mask), left
    return (left << shift) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Where the permutation of [0, n) takes each row number (or, inverted, what it brings there)."""
    k, keys, step = half_bits(n), round_keys(seed), _inverse if inverse else _network
    out = step(rows.astype(np.uint64), k, keys)
    while len(away := np.flatnonzero(out >= n)):
        out[away] = step(out[away], k, keys)
    return out.astype(np.int64)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_h"),
        F.monotonically_increasing_id().alias("_read"),
    )
    order = [id_col, "size", "text_crc32", "_h", "_read"]
    ranked = cut(slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("_h", "_read"))
    ranked = ranked.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in ranked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    n, offset = sum(counts.values()), np.zeros(max(counts, default=0) + 1, np.int64)
    for p in sorted(counts)[:-1]:
        offset[p + 1 :] += counts[p]

    @F.pandas_udf("long")
    def placed(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series(permute(offset[at >> 33] + (at & ((1 << 33) - 1)), n, seed))

    return ranked.withColumn("_to", placed("_at")).select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_to") % shards).cast("int").alias("shard"), F.expr(f"_to div {int(shards)}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
