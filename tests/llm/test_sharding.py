import zlib

import numpy as np
import pytest

from tessera.llm.sharding import permute, shard_rows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65537])
def test_permutation(n):
    out = permute(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    assert permute(out, n, inverse=True).tolist() == list(range(n))
    if n > 100:
        assert (out != np.arange(n)).mean() > 0.9
        assert (permute(np.arange(n), n, seed=1) != out).mean() > 0.9


def test_shards(spark):
    rows = [(i % 70 if i % 9 else None, None if i % 13 == 0 else "é" * (i % 5), "x") for i in range(203)] + [(5, "same", "x")] * 90
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    got = shard_rows(docs, 8).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(slots) == list(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    key = lambda rows: sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in rows)
    assert key(got) == key(shard_rows(docs.repartition(2), 8).collect())


def test_empty(spark):
    assert shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_against_brute_force(spark):
    """Shard and slot from row numbers: a network of Python numbers, walked until it is back in the table."""
    from tessera.llm.sharding import ROUNDS, SEED

    full = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & full
        return x ^ x >> 31

    keys = [mixed((SEED + (i + 1) * 0x9E3779B97F4A7C15) & full) for i in range(ROUNDS)]
    rows = [(i * 7 % 301, "x" * (i % 11)) for i in range(301)] + [(None, "null id")]
    n, k = len(rows), 1
    while 4**k < n:
        k += 1

    def moved(x):
        while True:
            left, right = x >> k, x & (1 << k) - 1
            for key in keys:
                left, right = right, left ^ mixed((right + key) & full) & (1 << k) - 1
            x = left << k | right
            if x < n:
                return x

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {r[0]: (moved(at) % 8, moved(at) // 8) for at, r in enumerate(order)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert {r.doc_id: (r.shard, r.slot) for r in shard_rows(docs, 8).collect()} == want
