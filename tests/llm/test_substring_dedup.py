import hashlib
import random
from collections import Counter

from tessera.llm.substring_dedup import substring_dedup


def brute(rows, size):
    words = [(t or "").encode().split() for t in rows]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("aé b cc d x e  f ß".split(" "))
    passage = " ".join(word() + str(rnd.randrange(9)) for _ in range(30))
    texts = [None, "", " \t\n", "one", passage, passage, f"x {passage} y\x0bz\x1c", f"{passage} {passage}"]
    texts += [" ".join(rnd.choice([word(), passage]) for _ in range(rnd.randrange(12))) for _ in range(40)]
    texts += ["\n".join(["same line here"] * 50), "w" * 3_000_000, " ".join(str(i) for i in range(300_000))]
    rows = [(None if i == 3 else i // 2 * 2, t, "l", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int").repartition(3)
    for size in (3, 35):
        got = substring_dedup(docs, size, block_bytes=20_000, bucket_windows=100)
        assert got.columns == ["doc_id", "text", "lang", "n_words", "n_removed", "intervals", "kept_text"]
        want = Counter((r[0], r[1] and hashlib.md5(r[1].encode()).hexdigest(), *b) for r, b in zip(rows, brute(texts, size)))
        rows_got = got.collect()
        assert Counter((r.doc_id, r.text and hashlib.md5(r.text.encode()).hexdigest(), r.n_words, r.n_removed, r.kept_text) for r in rows_got) == want
        for r in rows_got:
            assert sum(b - a for a, b in r.intervals) == r.n_removed
            assert all(x[1] < y[0] for x, y in zip(r.intervals, r.intervals[1:]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(docs).count() == 0


def test_buckets_are_told_by_another_hash():
    """Windows of one bucket have evenly spread hashes: the bucket's number adds to their bits."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm.substring_dedup import _windows

    *_, hashes, _, _, bucket, _ = _windows(pa.array([" ".join(str(i) for i in range(40_000))]), 5, 4)
    low = (hashes[bucket == 2] >> np.uint64(32)) % np.uint64(4)
    assert len(hashes) == 39_996 and (np.bincount(low.astype(int), minlength=4) > 2000).all()


def test_equal_rows_spread(spark):
    """Repeated rows under one id and under null ids count as places each."""
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text)] * 6 + [(None, text)] * 6, "doc_id long, text string").repartition(4)
    assert {r.n_removed for r in substring_dedup(docs, block_bytes=300).collect()} == {40}
