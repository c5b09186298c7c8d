import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import ppm
from tessera.llm.ppm import score_texts


def words_of(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [*lower.split(), b"\n"]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows, order):
    """PPM by dictionaries, one byte at a time, with contexts that run through the whole text."""
    coded = lambda t: bytes(ppm.ORDER) + b"".join(w + b" " for w in words_of(t)[:-1]) + b"\n"
    train = Counter(w for i, t in rows if not held_out(i) for w in words_of(t))
    count = defaultdict(Counter)
    for i, t in rows:
        if not held_out(i):
            c = coded(t)
            for j in range(ppm.ORDER, len(c)):
                for k in range(order + 1):
                    count[c[j - k : j]][c[j]] += 1

    def probability(context, s):
        p, out = 1.0, set()
        for k in range(order, -1, -1):
            own = count.get(context[len(context) - k :])
            if not own:
                continue
            free = {x: n for x, n in own.items() if x not in out}
            total = sum(free.values())
            if s in free:
                return p * (free[s] - ppm.ESCAPE) / total
            if total:
                p *= ppm.ESCAPE * len(free) / total
            out = set(own)
        return p / (256 - len(out))

    n, v = sum(train.values()), len(train)
    memo, result = {}, []
    for i, t in rows:
        ws, c, score = words_of(t), coded(t), 0.0
        for j in range(ppm.ORDER, len(c)):
            key = c[j - ppm.ORDER : j + 1]
            if key not in memo:
                memo[key] = math.log10(probability(key[:-1], key[-1]))
            score += memo[key]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws)
        result.append((i, held_out(i), len(ws), sum(train[w] > 0 for w in ws), n, base, score))
    for c in random.Random(1).sample(sorted(c for c in count if len(c) == order), 20):  # a proper distribution
        assert abs(sum(probability(c, s) for s in range(256)) - 1) < 1e-9
    return result


def corpus(seed, rows, words):
    rnd = random.Random(seed)
    syllables = "th er an Ing ou é ß tion".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    texts = [None, "", " \n", "x", *(" ".join(word() for _ in range(rnd.randrange(words))) for _ in range(rows))]
    texts += ["y" * 5000, "rare Ünseen", " lead  and\ttrail ", "nul \x00\x00 inside"]
    return [(None if i == 7 else i, t) for i, t in enumerate(texts)] + [(3, "x")] * 3


@pytest.mark.parametrize(("order", "small"), [(6, False), (6, True), (3, True)])
def test_against_brute_force(spark, monkeypatch, order, small):
    """At production values, and with blocks, buckets and pieces so small that there are many of each."""
    options = {"block_bytes": 500, "bucket_bytes": 900} if small else {}
    if small:
        monkeypatch.setattr(ppm, "PIECE", 700)
        monkeypatch.setattr(ppm, "PIECE_ROWS", 3)
    rows = corpus(8, 60, 40)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    got = sorted((r.doc_id or -1, r.n_tokens, r.score, r) for r in score_texts(docs, order, **options).collect())
    want = sorted((w[0] or -1, w[2], w[6], w) for w in brute(rows, order))
    assert len(got) == len(want)
    for (*_, r), (*_, w) in zip(got, want):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert abs(r.base_score - w[5]) < 1e-6 * (1 - w[5]) and abs(r.score - w[6]) < 1e-6 * (1 - w[6])


def test_pieces_do_not_change_the_sums(monkeypatch):
    """A text that spans many pieces counts as one text."""
    import pyarrow as pa

    t = pa.table({"text": ["Ab cd " * 300, "", None, "z"], ppm._TRAIN: [True, False, True, True]})
    whole = ppm.block_nodes(t, 6)
    monkeypatch.setattr(ppm, "PIECE", 17)
    parts = ppm.block_nodes(t, 6)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    scores = np.random.default_rng(0).random(len(parts[0]))
    monkeypatch.setattr(ppm, "PIECE", 1 << 20)
    want = ppm._sums(t, whole[0], scores, 6)
    monkeypatch.setattr(ppm, "PIECE", 17)
    assert np.allclose(want, ppm._sums(t, whole[0], scores, 6))


def test_packing():
    keys = np.array([0, 5, 2**63, 2**64 - 1], np.uint64)
    assert (ppm.unpack(ppm.pack(keys), 4) == keys).all() and len(ppm.unpack(ppm.pack(keys[:0]), 0)) == 0
    assert (ppm.unpack_counts(ppm.pack_counts(np.array([0, 7, 2**32 - 1])), 3) == [0, 7, 2**32 - 1]).all()


def test_word_order_counts(spark):
    """Contexts cross words: a text of known neighbours scores above the same words in another order."""
    rnd = random.Random(5)
    names = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    text = " ".join(names * 30)
    shuffled = names * 30
    rnd.shuffle(shuffled)
    ids = [i for i in range(200) if held_out(i)]
    rows = [(next(i for i in range(100) if not held_out(i)), text), (ids[0], text), (ids[1], " ".join(shuffled))]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[ids[0]].base_score == pytest.approx(got[ids[1]].base_score)
    assert got[ids[0]].score > got[ids[1]].score + 20


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert score_texts(none).count() == 0
    only = next(i for i in range(100) if held_out(i))
    row = score_texts(spark.createDataFrame([(only, "ab")], "doc_id long, text string")).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.base_score == 0
    assert abs(row.score + 4 * math.log10(256)) < 1e-5
