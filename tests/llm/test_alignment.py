import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment
from tessera.llm.alignment import TOKENIZER_A, TOKENIZER_B, Tokenizers, align, pair_counts

ODD = [
    None, "", " ", "  two  spaces ", "Don't stop", "Ünïcode naïve élève", "日本語のテスト", "line\nbreak\n\n  indented\ttab", "▁marked", "a▁b", "<|endoftext|> plain", "<s> </s> <unk> <0x41>",
    "x" * 500, "=" * 700 + " ok", "\U0001f600\U0001f468‍\U0001f469", "nul \x00 \x1c\x1f fs", "nbsp  here 　wide", "soft­hyphen", "trailing space ", "a b", "one", " lead", "12,345.67 8", "end\r\n",
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(TOKENIZER_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=TOKENIZER_B)


def table_of_letters():
    solid = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in solid]
    return {chr(b): b for b in solid} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens(both, text):
    """(id, bytes) of both sides, by the libraries on the whole text; nothing where they don't give the text again."""
    if not text:
        return [], []
    a, b = both
    letters = table_of_letters()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (left, right)):
        return [], []
    return left, right


def groups_of(left, right):
    ends = []
    for side in (left, right):
        at, own = 0, []
        for _, x in side:
            at += len(x)
            own.append(at)
        ends.append(own)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in cuts]
    for k, side in enumerate((left, right)):
        for (i, _), end in zip(side, ends[k]):
            out[next(j for j, c in enumerate(cuts) if c >= end)][k].append(i)
    return out


def brute(both, rows):
    per, counts = [], Counter()
    for i, text in rows:
        left, right = tokens(both, text)
        groups = groups_of(left, right)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        per.append((i, left, right, groups, links))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = Counter()
    for i, left, right, groups, links in per:
        said = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        best = sum(counts[p] == highest[p[0]] for p in links)
        out[i, len(left), len(right), len(groups), len(links), best, sum(counts[p] for p in links), said] += 1
    return out, counts, highest


def sample(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    return [(i, t) for i, t in enumerate(ODD + texts)] + [(None, "a b"), (3, "again again"), (3, "again again"), (3, "again again")]


def test_words_equal_the_libraries(spark, both):
    with open(TOKENIZER_A, encoding="utf-8") as f, open(TOKENIZER_B, "rb") as g:
        tok = Tokenizers(f.read(), g.read())
    assert tok.apart and tok.fast
    for _, text in sample(spark) * 2:
        left, right = tokens(both, text)
        got = tok.encode(text or "")
        assert [x.tolist() for x in got] == [[i for i, _ in left], [i for i, _ in right]], (text or "")[:60]


@pytest.mark.parametrize("stretch,step,block,listed", [(1 << 15, 1 << 16, 4 << 20, 1 << 14), (5, 16, 20_000, 2)])
def test_against_brute_force(spark, both, monkeypatch, stretch, step, block, listed):
    for name, value in (("STRETCH", stretch), ("STEP", step), ("LISTED", listed), ("SLICE", 1 << 23 if step > 16 else 50)):
        monkeypatch.setattr(alignment, name, value)
    rows = sample(spark)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    want, counts, highest = brute(both, rows)
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in align(docs, block_bytes=block).collect())
    assert got == want
    found = {(r.a, r.b): (r.documents, r.best) for r in pair_counts(docs, block_bytes=block).collect()}
    assert found == {p: (n, n == highest[p[0]]) for p, n in counts.items()}


def test_query(spark, both):
    from tessera.llm.queries import op12_alignment

    row = op12_alignment(spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    want = brute(both, [(row.doc_id, text)])[0].most_common(1)[0][0]
    assert (row.n_a, row.n_b, row.n_groups, row.n_links) == want[1:5] and row.groups_sha256 == hashlib.sha256(want[7].encode()).hexdigest()


def test_empty(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = align(spark.createDataFrame([("k", None)], "name string, text string"), id_col="name").collect()
    assert [tuple(r) for r in got] == [("k", 0, 0, 0, 0, 0, 0, "")]
