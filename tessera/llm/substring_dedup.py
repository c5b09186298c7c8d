"""Substring dedup: repeated windows of words, found by Rabin-Karp hashes counted in Spark.

A window is ``size`` consecutive words of one document.  Every window of the
corpus is hashed; hashes are counted exactly in Spark; a word is removed if some
window over it starts at another place too.  Overlapping repeated windows merge
into maximal removal intervals.

Plan.  Rows are dealt into blocks of about a megabyte of text by a hash of
doc_id, text and partition, so that copies of one text, and equal rows of different
partitions, spread over the blocks.  A block sends its window hashes, packed eight bytes each, to counting
buckets; a bucket answers each block with one bit for each hash it sent; the
block turns the bits into intervals.  The text is shuffled once (both uses read
one exchange), hashes once, the answers are an eighth of a byte a window.  A
hash that a block holds many times is sent once, so a hot passage costs a bucket
at most one entry a block.  Blocks and buckets follow the size of the input.

Defined cases: null text counts as empty; texts under ``size`` words lose
nothing; repeated rows count as two places; incoming columns named like the
results are replaced.  
Two windows are taken for one if they share a bucket and a hash of 64 bits.  The bucket
comes from a second hash, over other values of the words, so of n windows about
n * BUCKET_WINDOWS / 2**65 pairs are falsely equal: 0.0001 at 4.7e9 windows (30 GB), 0.3
at 10**13.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, text_bytes, window_hashes, word_bounds, word_hashes

SIZE = 35
BLOCK_BYTES = 1 << 20
#: Windows that one counting bucket holds on average.
BUCKET_WINDOWS = 1 << 20
_OTHER = np.uint64(0x5851F42D4C957F2D)
OUT = ("n_words", "n_removed", "intervals", "kept_text")
_BLOCK, _BUCKET, _BITS, _ROW = "_tessera_block", "_tessera_bucket", "_tessera_bits", "_tessera_row"


def _windows(column: pa.Array, size: int, buckets: int):
    """Hashes of all windows of some rows, grouped by bucket, with what leads back to their places."""
    data, offsets = text_bytes(column)
    start, end, first = word_bounds(data, offsets)
    n = len(start)
    words = word_hashes(data, start, end)
    hashes, second = window_hashes(words, size), window_hashes(mix(words ^ _OTHER), size)
    row_end = np.repeat(first[1:], np.diff(first))
    place = np.flatnonzero(np.arange(len(hashes)) + size <= row_end[: len(hashes)])
    hashes, at, turn, count = np.unique(hashes[place], return_index=True, return_inverse=True, return_counts=True)
    bucket = ((second[place][at] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return data, start, end, first, n, place, hashes, turn, count, bucket, order


def _send(size: int, buckets: int):
    def send(key, t):
        t = _sorted(t)
        *_, hashes, _, count, bucket, order = _windows(t.column("text"), size, buckets)
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        rows = [order[cuts[b] : cuts[b + 1]] for b in full]
        return pa.table({
            _BUCKET: pa.array(full.astype(np.int32)),
            _BLOCK: pa.array([key[0].as_py()] * len(full), pa.int64()),
            "hashes": pa.array([hashes[r].tobytes() for r in rows], pa.binary()),
            "twice": pa.array([np.packbits(count[r] > 1).tobytes() for r in rows], pa.binary()),
        })

    return send


def _answer(key, t):
    """For each block, which of the hashes that it sent to this bucket occur at two places or more."""
    parts = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
    sizes = np.array([len(x) for x in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    order = np.argsort(flat)
    ranked = flat[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(flat), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    bits, at = [], 0
    for own, n in zip(t.column("twice").to_pylist(), sizes):
        bits.append(np.packbits(twice[at : at + n] | np.unpackbits(np.frombuffer(own, np.uint8), count=n).astype(bool)).tobytes())
        at += n
    return pa.table(
        {
            _BLOCK: t.column(_BLOCK),
            _BUCKET: pa.array([key[0].as_py()] * len(t), pa.int32()),
            _BITS: pa.array(bits, pa.binary()),
            "n": pa.array(sizes.tolist(), pa.int32()),
        }
    )


def _sorted(t: pa.Table) -> pa.Table:
    return t.sort_by([(_ROW, "ascending")]).combine_chunks() if len(t) else t


def _runs(mask: np.ndarray) -> list[list[int]]:
    """Maximal runs of true, as [first, end) pairs."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).tolist()


def _apply(size: int, buckets: int, names: list[str]):
    def apply(key, docs, answers):
        docs = _sorted(docs)
        data, start, end, first, n, place, hashes, turn, _, bucket, order = _windows(docs.column("text"), size, buckets)
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        repeated = np.zeros(len(hashes), bool)
        for b, bits, sent in zip(*(answers.column(c).to_pylist() for c in (_BUCKET, _BITS, "n"))):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own) != sent:
                raise RuntimeError("a block's rows changed between its two readings")
            repeated[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        hit = place[repeated[turn]] if len(place) else place
        cover = np.zeros(n + 1, np.int32)
        cover[hit] += 1
        cover[hit + size] -= 1
        gone = np.cumsum(cover[:n]) > 0
        kept, removed, spans = [], [], []
        raw = data.tobytes()
        for i in range(len(docs)):
            a, z = first[i], first[i + 1]
            mask = gone[a:z]
            words = raw[start[a] : end[z - 1]].split() if z > a else []
            removed.append(int(mask.sum()))
            spans.append(_runs(mask) if removed[-1] else [])
            kept.append(b" ".join([w for w, g in zip(words, mask.tolist()) if not g] if removed[-1] else words).decode())
        out = {c: docs.column(c) for c in names}
        return pa.table(out | {
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "intervals": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
            "kept_text": pa.array(kept, pa.string()),
        })

    return apply


def substring_dedup(docs: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """``docs`` (doc_id, text, more) with n_words, n_removed, intervals ([first, end) words removed) and kept_text.

    kept_text is the kept words joined by one space.
    """
    docs = docs.drop(*OUT, _BLOCK, _BUCKET, _BITS, _ROW)
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    blocks, buckets = max(1, total // block_bytes), max(1, total // 6 // bucket_windows)
    names = docs.columns
    dealt = (
        docs.withColumn(_ROW, F.xxhash64(F.col("doc_id").cast("string"), text, F.spark_partition_id()))
        .withColumn(_BLOCK, F.pmod(F.col(_ROW), F.lit(blocks)))
    )
    sent = dealt.groupBy(_BLOCK).applyInArrow(_send(size, buckets), f"{_BUCKET} int, {_BLOCK} long, hashes binary, twice binary")
    answers = sent.groupBy(_BUCKET).applyInArrow(_answer, f"{_BLOCK} long, {_BUCKET} int, {_BITS} binary, n int")
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("intervals", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("kept_text", T.StringType()),
        ]
    )
    return dealt.groupBy(_BLOCK).cogroup(answers.groupBy(_BLOCK)).applyInArrow(_apply(size, buckets, names), schema)
