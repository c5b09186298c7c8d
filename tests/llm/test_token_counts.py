import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.token_counts import LEAF, RANKS, Counter, Tree, apply_edit, count_tokens, edit_counts, leaves


@pytest.fixture(scope="module")
def counter():
    import base64

    with open(RANKS, "rb") as f:
        return Counter({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def whole(counter, text):
    return len(counter.coder.encode_ordinary(text))


def test_edits_against_recounting(counter):
    rnd = random.Random(6)
    bits = ["word", " ", "  ", "\n", "12", "'ll", "é", "!!", " the", "日本", "\t\n ", "x" * 30, "'s"]
    for _ in range(400):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 300)))
        tree = Tree(counter.leaves(text))
        for _ in range(6):
            a = rnd.randrange(-2, len(text) + 3)
            b = a + rnd.choice([0, 0, 1, 5, 60])
            text, _ = apply_edit(counter, text, tree, a, b, "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 5))))
            assert tree.total == whole(counter, text)
            assert sum(c for c, _ in tree.leaves) == len(text)
            at = 0
            for c, t in tree.leaves:  # leaves cut where the pattern cuts
                assert sum(n for e, n in counter.cut(text, at) if e <= at + c) == t
                at += c


def test_an_edit_touches_its_neighbourhood_only(counter):
    text = "some words of a long text. " * 20_000
    tree = Tree(counter.leaves(text))
    edited, work = apply_edit(counter, text, tree, 300_000, 300_004, "other things")
    assert tree.total == whole(counter, edited) and work <= 4 * LEAF


def test_tables(spark, counter):
    texts = [None, "", "one", "two words", "a b c " * 50_000, "same", "same"]
    docs = spark.createDataFrame([(i if i < 6 else 5, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x")], "doc_id long, text string, n_tokens string").repartition(3)
    index = count_tokens(docs)
    assert sorted((str(r.doc_id), r.n_tokens) for r in index.collect()) == sorted([(str(i if i < 6 else 5), whole(counter, t or "")) for i, t in enumerate(texts)] + [("None", whole(counter, "null id"))])
    edits = spark.createDataFrame([(3, 2, 0, 3, "three"), (3, 1, 0, 0, "X "), (3, 3, 99, 120, None), (5, 1, 4, 4, " text"), (0, 1, 0, 0, "new"), (77, 1, 0, 0, "no"), (None, 1, 0, 0, "no"), (4, 1, 10, 20, "")], "doc_id long, seq int, start int, end int, replacement string")
    got = edit_counts(index, edits).withColumn("bottom", leaves(F.col("tree"))).collect()
    want = {"3": "three" + "X two words"[3:], "5": "same text", "0": "new", "4": texts[4][:10] + texts[4][20:], "1": "", "2": "one", "None": "null id"}
    assert len(got) == 8
    for r in got:
        assert (r.text or "") == want[str(r.doc_id)] and r.n_tokens == whole(counter, r.text or "") == sum(x.tokens for x in r.bottom)
        assert (r.recut > 0) == (str(r.doc_id) in "3504")
    assert edit_counts(count_tokens(docs.where("false")), edits).count() == 0
    assert edit_counts(index, edits.where("false")).count() == 8


def test_query_against_recounting(spark, counter):
    import zlib

    from tessera.llm.queries import op3_token_counts
    from tests.conftest import SF

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]
        at = zlib.crc32(str(r.doc_id).encode()) % (len(text) + 1)
        assert r.n_before == whole(counter, text)
        assert r.n_after == whole(counter, text[:at] + " edited 2 words" + text[at + 9 :])


def test_null_positions(spark, counter):
    """A null start is 0, a null end the start; null texts are empty; no index row is shuffled for few edits."""
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (4, "as it was"), (4, None)], "doc_id long, text string")
    rows = [(1, 1, None, 3, "X"), (2, 1, 3, None, " and"), (3, None, None, None, "new text"), (3, 2, None, None, None)]
    edits = spark.createDataFrame(rows, "doc_id long, seq int, start int, end int, replacement string")
    out = edit_counts(count_tokens(docs), edits)
    got = sorted((r.doc_id, r.text, r.n_tokens) for r in out.where("doc_id < 4 or text is not null").collect())
    want = [(1, "X two"), (2, "one and two"), (3, "new text"), (4, "as it was")]
    assert got == [(i, t, whole(counter, t)) for i, t in want]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_query_with_null_texts(spark, counter, tmp_path):
    from tessera.llm.queries import op3_token_counts

    spark.createDataFrame([(1, None), (2, "some text"), (None, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_before, r.n_after) for r in op3_token_counts(spark, str(tmp_path)).collect()}
    assert got[1] == got[3] == (0, whole(counter, " edited 2 words")) and got[None] == (0, 0) and got[2][0] == 2


def test_trees_are_updated_not_rebuilt(counter, monkeypatch):
    """Edits of a few words change the paths above their leaves; sums stay right."""
    text = "some words of a long text. " * 3000
    tree = Tree(counter.leaves(text))
    built = []
    monkeypatch.setattr(Tree, "_build", lambda self, leaves, f=Tree._build: (built.append(1), f(self, leaves))[1])
    rnd = random.Random(2)
    for _ in range(40):
        a = rnd.randrange(len(text))
        text, _ = apply_edit(counter, text, tree, a, a + rnd.choice([0, 3, 40]), rnd.choice(["", " a", " two words", " x" * 20]))
        assert tree.total == whole(counter, text)
    assert len(built) <= 3
    rows, size = tree.rows, tree.size
    assert (rows[1:size] == rows[2 : 2 * size : 2] + rows[3 : 2 * size : 2]).all() and rows[1, 0] == len(text)
