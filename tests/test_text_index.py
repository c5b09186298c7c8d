import math
import random
import uuid

import pytest

from tessera.operators import search as S
from tessera.operators.text_index import TextIndex


def occurrences(text, phrase):
    text, phrase = (text or "").lower(), phrase.lower()
    return sum(text.startswith(phrase, i) for i in range(len(text)))


def brute(rows, phrase):
    """Scores by the formula over all rows: {id: score}."""
    length = {i: sum(max(0, len(t or "") - 2) for t in texts) for i, *texts in rows}
    found = {i: sum(occurrences(t, phrase) for t in texts) for i, *texts in rows}
    n, m, mean = len(rows), sum(f > 0 for f in found.values()), sum(length.values()) / len(rows)
    idf = max(math.log((n - m + 0.5) / (m + 0.5)), 1e-6)
    return {i: -idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[i] / mean)) for i, f in found.items() if f}


def same(index, rows, phrases):
    for phrase in phrases:
        got = {r.row_id: r.score for r in index.bm25(phrase).collect()}
        want = brute(rows, phrase)
        assert got.keys() == want.keys(), phrase
        assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want), phrase


PHRASES = ["ana", "anan", "Ban Ana", "ééé", "日本語", "aaaa", "zzz", "na b", "\U0001f600ab"]


def some_rows(seed, ids):
    draw = random.Random(seed)
    words = ["banana", "ana", "BAN", "ééééé", "日本語日本語", "aaaaaaa", "x", "", "\U0001f600ab", "anan"]
    return [(i, " ".join(draw.choices(words, k=draw.randrange(0, 9))) if draw.random() > 0.1 else None, draw.choice(words)) for i in ids]


def test_segments_deletes_upserts_and_merges(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "id long, title string, body string").repartition(3)
    index = TextIndex.create(spark, f"file://{tmp_path}/i", ["title", "body"], buckets=8)
    assert index.bm25("ana").count() == 0
    first, second = some_rows(1, range(60)), some_rows(2, range(60, 100))
    index = index.append(frame(first)).append(frame(second))
    same(index, first + second, PHRASES)
    old = index
    index = index.delete(frame(first).where("id % 3 = 0")).delete(spark.createDataFrame([(1000,)], "id long"))
    rows = [r for r in first if r[0] % 3] + second
    same(index, rows, PHRASES)
    changed = some_rows(3, range(50, 70)) + [(0, "banana again", None)]
    index = index.upsert(frame(changed))
    rows = [r for r in rows if r[0] not in {c[0] for c in changed}] + changed
    same(index, rows, PHRASES)
    same(old, first + second, ["ana"])  # a reader of an earlier version
    index = index.merge()
    same(index, rows, PHRASES)
    index.vacuum()
    same(TextIndex(spark, f"file://{tmp_path}/i"), rows, PHRASES)
    assert len(index.live) == 1 and len([p for p in (tmp_path / "i" / "postings").iterdir() if p.name.startswith("segment")]) == 1
    same(index.delete(frame(rows[:5])), rows[5:], ["ana"])
    with pytest.raises(ValueError):
        index.search("ab")


def test_a_version_is_written_once(spark, tmp_path):
    """Of two writers that started from one version the second fails, and readers see the first."""
    rows = spark.createDataFrame([(1, "banana")], "id long, title string")
    start = TextIndex.create(spark, f"file://{tmp_path}/i", ["title"])
    start.append(rows)
    with pytest.raises(Exception):
        start.append(rows)
    assert TextIndex(spark, f"file://{tmp_path}/i").bm25("nan").count() == 1


def test_only_the_buckets_of_the_phrase_are_read(spark, tmp_path):
    rows = spark.createDataFrame(some_rows(5, range(300)), "id long, title string, body string")
    index = TextIndex.create(spark, f"file://{tmp_path}/i", ["title", "body"], buckets=32).append(rows)
    plan = index.search("anan")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0] and "gram" in scan.split("PushedFilters")[1]
    files = index._read("postings", [1]).where("bucket in (3, 4)").select("bucket").distinct().count()
    assert files <= 2 and "title" not in plan


def test_keyword_hits_through_indexes(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, b, "web" if i % 2 else "book") for i, t, b in some_rows(8, range(80))], "id long, title string, card_summary string, source string")
    chunks = spark.createDataFrame([(1000 + i, i % 80, t) for i, t, _ in some_rows(9, range(200))], "id long, document_id long, text string")
    heads = TextIndex.create(spark, f"file://{tmp_path}/{uuid.uuid4()}", ["title", "card_summary"]).append(docs)
    bodies = TextIndex.create(spark, f"file://{tmp_path}/{uuid.uuid4()}", ["text"]).append(chunks)
    for phrase in ("anan", "日本語", "nothing of this"):
        for sources in (None, ["web"]):
            want = [tuple(r) for r in S.keyword_hits(docs, chunks, phrase, sources).orderBy("rank").collect()]
            assert [tuple(r) for r in S.keyword_hits(docs, chunks, phrase, sources, heads, bodies).orderBy("rank").collect()] == want
