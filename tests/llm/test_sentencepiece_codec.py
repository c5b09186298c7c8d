import random

import numpy as np
import pytest
import sentencepiece

from tessera.llm.sentencepiece_codec import MARK, MODEL, Encoder, Vocabulary, decode, decode_ids, encode, merge_by_rank, model_kind


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL), Encoder(Vocabulary.load(MODEL))


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_random_texts_against_the_library(model):
    sp, e = model
    rnd, names = random.Random(9), list(e.v.ids)
    assert e.v.kind == "bpe"
    for _ in range(3000):
        text = "".join(rnd.choice([rnd.choice(names), rnd.choice("aeiou \n\tß日①é$#")]) for _ in range(rnd.randrange(1, 9)))
        assert ids(e.encode(text)) == sp.encode(text)


def test_the_window_stays_small(model):
    sp, e = model
    rnd, widths = random.Random(4), []
    text = "".join(rnd.choice("abcdefgh$") for _ in range(20_000))
    assert ids(e.search(MARK + text, widths)) == sp.encode(text)
    assert max(widths) < 600
    long = "$" * 5000
    assert ids(e.search(MARK + long)) == sp.encode(long)


def test_unigram_search_against_brute_force():
    rnd = random.Random(2)
    pieces = ["<unk>", *"abc", "ab", "bc", "abc", "ca", MARK, MARK + "a", "cab"]
    scores = [0.0, *(-rnd.random() * 5 for _ in pieces[1:])]
    e = Encoder(Vocabulary(pieces, scores, "unigram", {0}, {}, 0))

    def best(text):
        if not text:
            return 0.0
        return max(scores[e.v.ids[text[:k]]] + best(text[k:]) for k in range(1, 4) if text[:k] in e.v.ids)

    for _ in range(200):
        text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12)))
        found = ids(e.search(text).tobytes())
        assert "".join(pieces[i] for i in found) == text
        assert abs(sum(scores[i] for i in found) - best(text)) < 1e-9
    long = "".join(rnd.choice("abc") for _ in range(5000))
    assert "".join(pieces[i] for i in e.search(long)) == long
    assert ids(e.encode("ax b")) == [e.v.ids[MARK + "a"], 0, e.v.ids[MARK], e.v.ids["b"]]


def test_merge_by_rank():
    assert merge_by_rank(list("aaa"), {"aa": 0})[0] == ["aa", "a"]


def test_tables(spark, model):
    sp, _ = model
    texts = [None, "", " ", "one", "a" * 200_000, "tab\there", "  two  spaces ", "emoji 🙂 \x00 end", "one", "x y " * 100_000]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "keep") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    both = encode(docs, decoded="again")
    assert both.columns == ["doc_id", "text", "ids", "again"]
    rows = decode(both).collect()
    assert sorted(str(r.text and r.text[:9]) for r in rows) == sorted(str(t and t[:9]) for t in texts)
    for r in rows:
        assert r.decoded == r.text == r.again
        assert r.ids is None if r.text is None else r.ids == sp.encode(r.text)
    assert decode(encode(docs.where("false"))).count() == 0
    assert decode_ids([b"a"], np.array([0, 7, -1])) == "a"


def test_models_are_read_or_refused(model):
    sp, _ = model
    proto = sp.serialized_model_proto()
    assert model_kind(proto) == "bpe"
    part = lambda field, *pairs: bytes([field << 3 | 2, sum(map(len, pairs))]) + b"".join(pairs)
    number = lambda field, value: bytes([field << 3, value])
    plain = part(3, number(4, 0))
    assert model_kind(part(2, number(3, 1)) + plain) == "unigram"
    refused = [
        part(2, number(3, 3)) + plain,  # words
        part(2, number(3, 1)) + part(3, part(2, b"map"), number(4, 0)),  # a character map
        part(2, number(3, 2)) + part(3, number(4, 1)),  # extra spaces removed
        part(2, number(3, 2)) + part(3, number(3, 0), number(4, 0)),  # no space in front
    ]
    for raw in refused:
        with pytest.raises(ValueError):
            model_kind(raw)


def test_models_with_other_pieces_are_refused(model):
    """A space mark inside a piece, and symbols that the library cuts out first."""
    sp, _ = model
    proto = sp.serialized_model_proto()
    piece = lambda text, kind: bytes([1 << 3 | 2, len(text.encode()) + 4]) + bytes([1 << 3 | 2, len(text.encode())]) + text.encode() + bytes([3 << 3, kind])
    assert model_kind(proto + piece("▁▁x", 1)) == "bpe" and model_kind(proto + piece("a▁b", 3)) == "bpe"
    for odd in (piece("▁a▁b", 1), piece("a▁", 1), piece("<mark>", 4)):
        with pytest.raises(ValueError):
            model_kind(proto + odd)
