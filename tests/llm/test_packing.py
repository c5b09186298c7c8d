import json
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm.packing import GROUPS, SHARES, TOKENIZER, Packing, Words, best_packing, configurations, optimise, pack

ODD = [
    "Don't stop, Ünïcode! it's 12,345 o'clock", "ΣΑΣ ΟΔΟΣ Σ", "İstanbul ǅ ŉ ß ẞ", "á ëx ́ alone", "tabs\tand\nnew  lines \r\n  end ", " ", "", "日本語 テスト 漢字かな", "<|endoftext|> in <|startoftext|>text x<|endoftext|>y",
    "x" * 3000, "emoji \U0001f600\U0001f468‍\U0001f469 ok", "soft­hyphen nbsp here  line", "\x00nul \x1f\x7f\x85 ctl", "ﬁ ligature ½ ² ª", "naïve café élève'sœur l'été d'accord", "'s 't're'llx", "ABC.DEF_ghi-jkl/mno:42",
]


@pytest.fixture(scope="module")
def config():
    with open(TOKENIZER, encoding="utf-8") as f:
        return f.read()


def test_words_equal_the_library(spark, config):
    whole, words = Tokenizer.from_str(config), Words(config)
    assert words.apart
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text]
    for text in texts + [t for t in texts[:40]]:
        got = np.frombuffer(b"".join(words.ids(text)), "<u4").tolist()
        assert got == whole.encode(text, add_special_tokens=False).ids, text[:80]
    other = json.loads(config)
    other["normalizer"]["normalizers"].pop()
    plain = Words(json.dumps(other))
    assert not plain.apart and np.frombuffer(b"".join(plain.ids("Ab c")), "<u4").tolist() == Tokenizer.from_str(json.dumps(other)).encode("Ab c", add_special_tokens=False).ids


def test_long_texts_in_parts(config, monkeypatch):
    import tessera.llm.packing as module

    text = " ".join(random.Random(1).choices(["word", "", "Ünder", "a.b"], k=300)) + " "
    want = b"".join(Words(config).ids(text))
    monkeypatch.setattr(module, "SLICE", 11)
    assert b"".join(Words(config).ids(text)) == want


def check(histogram, room, packing):
    """Sequences from the runs: gapless, within the room, and all of them used."""
    length = np.repeat(np.arange(room + 1), histogram)
    sequence, offset = packing.place(np.arange(len(length)))
    order = np.lexsort((offset, sequence))
    s, o, end = sequence[order], offset[order], (offset + length)[order]
    first = np.append(True, s[1:] != s[:-1])
    assert (o[first] == 0).all() and (o[~first] == end[:-1][~first[1:]]).all() and (end <= room).all()
    assert len(np.unique(s)) == packing.sequences == (s.max() + 1 if len(s) else 0)


@pytest.mark.parametrize("seed", range(12))
def test_packings_hold(seed):
    draw = np.random.default_rng(seed)
    room = int(draw.choice([2, 3, 7, 64, 100]))
    lengths = draw.integers(1, room + 1, int(draw.integers(0, 400)))
    lengths = lengths[lengths >= draw.choice([1, room // 3 + 1])]
    histogram = np.bincount(lengths, minlength=room + 1)
    for share in SHARES:
        for groups in (1, 3, 64):
            check(histogram, room, Packing(histogram, room, groups, share))


def best_fit_decreasing(lengths, room):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(room - x)
    return len(rooms)


@pytest.mark.parametrize("low,high", [(1, 2048), (500, 1500), (600, 900), (1, 300), (1000, 1100)])
def test_few_sequences(low, high):
    lengths = np.random.default_rng(low).integers(low, high + 1, 1500)
    histogram = np.bincount(lengths, minlength=2049)
    packing = best_packing(histogram, 2048)
    check(histogram, 2048, packing)
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
    assert least <= packing.sequences <= best_fit_decreasing(lengths.tolist(), 2048)


def test_linear_program():
    sizes, demand = np.array([60, 50, 40, 30]), np.array([10, 20, 30, 40])
    used = optimise(sizes, demand, 100)
    for g in range(4):
        assert abs(sum(n * c.count(g) for c, n in used) - demand[g]) < 1e-6
    assert sum(n for _, n in used) == pytest.approx((60 * 10 + 50 * 20 + 40 * 30 + 30 * 40) / 100)
    found = {tuple(c) for c in configurations(sizes, 100)}
    assert (3, 3, 2) not in found and (2, 3, 3) in found and (0, 2, 4) in found and (0, 1, 4) not in found


def test_pack_documents(spark, config):
    whole = Tokenizer.from_str(config)
    rows = [(i % 50 if i % 7 else None, t, 1) for i, t in enumerate(ODD * 3)] + [(7, None, 2), (8, "word " * 5000, 3), (8, "word " * 5000, 3), (9, "word " * 2047, 0), (10, "word " * 2048, 0), (11, "word " * 4095, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(5)
    got = pack(docs, ids=True).collect()
    want = {}
    for i, text, _ in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            key = (i, piece, at, tuple(ids[at : at + 2048]))
            want[key] = want.get(key, 0) + 1
    found, places = {}, {}
    for r in got:
        key = (r.doc_id, r.piece, r.start, tuple(r.ids))
        found[key] = found.get(key, 0) + 1
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert found == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(GROUPS) > 1 and len(places) == -(-sum(r.length for r in got) // 2048)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
