from pyspark.sql import functions as F

from tessera.operators import pacing, rechunk, summarize


def test_summaries_of_long_texts(spark):
    """Pieces are summarised, their numbered summaries again; broken pieces are dropped, depth ends it."""
    body = " ".join(f"Sentence {i} is here." for i in range(40))
    rows = [(1, "short text"), (2, body), (3, None), (4, " "), (5, "bad " * 100), (6, "x" * 58 + " " + "bad " * 20)]
    texts = spark.createDataFrame(rows, "document_id long, text string")
    leaf = lambda t: F.when(~t.contains("bad"), F.concat(F.lit("s:"), F.substring(t, 1, 20)))
    got = {r.document_id: r.summary for r in summarize.summarize(texts, leaf, 60, 24, 3).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[1] == "s:short text" and got[3] is None and got[4] == "s:" and got[5] is None
    assert got[2].startswith("s:1. s:1. s:") and got[6].startswith("s:x")
    one = {r.document_id: r.summary for r in summarize.summarize(texts, leaf, 60, 24, 0).collect()}
    assert one[2] == "s:" + body[:20].strip()


def test_slots_follow_their_definition(spark):
    times = {"a": [0.0, 0.1, 0.2, 9.0, 9.5], "b": [3.0]}
    rows = [(i, k, t) for k, ts in times.items() for i, t in enumerate(ts)]
    got = {(r.domain, r.id): r.slot for r in pacing.fetch_slots(spark.createDataFrame(rows, "id long, domain string, ts double")).collect()}
    for k, ts in times.items():
        last = None
        for i, t in enumerate(ts):
            last = t if last is None else max(t, last + 1)
            assert abs(got[k, i] - last) < 1e-9


def test_rechunking(spark):
    """Old body chunks go only where new ones come, enrichment stays, numbers go on, blocks carry their pages."""
    docs = spark.createDataFrame([(1, "T", "card"), (2, "T", None), (3, None, None), (4, "T", None), (5, "T", None)], "id long, title string, card_summary string")
    long = "word " * 60
    block = "array<struct<index:int,title:string,page_start:int,page_end:int,offset:int,length:int>>"
    texts = spark.createDataFrame([(1, "tiny", None, False), (2, long + long, [(0, "a", 1, 2, 0, 300), (1, "b", None, None, 300, 300)], False), (3, " ", None, False), (4, long, None, True), (5, "no text", [(0, "a", 1, 2, 0, 7)], False)], f"document_id long, text string, blocks {block}, truncated boolean")
    chunks = spark.createDataFrame([(10, 1, 0, "old", None), (11, 1, 7, "sum", "summary"), (12, 2, 0, "old", "fulltext"), (13, 4, 0, "old", None), (14, 5, 0, "old", None)], "id long, document_id long, chunk_index long, text string, chunk_pass string")
    after, report = rechunk.rechunk(docs, texts, chunks)
    assert sorted(map(tuple, report.collect())) == [(1, 1, 1, 8), (2, 1, 2, 1)]
    rows = after.collect()
    assert {r.id for r in rows if r.id} == {11, 13, 14}
    new = sorted((r.document_id, r.chunk_index, r.chunk_pass, r.page_start, r.text[:14]) for r in rows if r.id is None)
    assert new == [(1, 8, None, None, "T\n\ncard\n\ntiny"), (2, 1, "fulltext", 1, "word word word"), (2, 2, "fulltext", None, "word word word")]


def test_purges(spark):
    import pytest

    from tessera.operators.purge import purge_target

    tables = {
        "documents": spark.createDataFrame([(1, "a", "unfetchable"), (2, "b", "fetched")], "id long, source string, fetch_status string"),
        "chunks": spark.createDataFrame([(1, 1, "summary", 5, "v1"), (2, 2, "summary", None, None), (3, 2, None, None, "v3")], "id long, document_id long, chunk_pass string, summary_run_id long, vector_id string"),
        "fetch_log": spark.createDataFrame([(1, 1), (2, 2)], "id long, document_id long"),
        "runs": spark.createDataFrame([(5, "p", "m")], "run_id long, provider string, model string"),
    }
    ids = lambda name, **scope: sorted(r.id for r in purge_target(tables, name, **scope)[0].collect())
    assert ids("summaries") == [3] and ids("summaries", source="a") == [2, 3] and ids("summaries", model="m") == [2, 3]
    assert ids("summaries", unknown=True) == [1, 3] and ids("summaries", run_id=9) == [1, 2, 3] and ids("fetch_failures") == [2]
    assert {r.id: r.vector_id for r in purge_target(tables, "vectors", source="b")[0].collect()} == {1: "v1", 2: None, 3: None}
    with pytest.raises(ValueError):
        purge_target(tables, "vectors", provider="p")
    with pytest.raises(ValueError):
        purge_target(tables, "nothing")


def test_every_piece_reaches_the_leaf(spark):
    """A leaf that reports what it saw: nothing is dropped, no call is over the limit, rounds end in one row."""
    import random

    draw = random.Random(4)
    texts = {1: " ".join(f"w{i}." for i in range(9000)), 2: "x" * 5000, 3: "a" * 300 + ". " + "bb " * 700, 4: "short"}
    texts |= {i: " ".join("y" * draw.randrange(1, 40) + draw.choice([".", "", "!"]) for _ in range(300)) for i in range(5, 9)}
    frame = spark.createDataFrame(list(texts.items()), "document_id long, text string")
    seen = []
    # letters that a text's pieces hold, counted from the numbers that the summaries below report
    count = lambda t: F.length(F.regexp_replace(t, r"\s", ""))
    total = lambda t: F.aggregate(F.transform(F.regexp_extract_all(t, F.lit(r"<(\d+)>")), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    leaf = lambda t: F.when(F.length(t) > 100, F.lit("over<-1>")).otherwise(F.concat(F.lit("<"), F.when(t.contains("<"), total(t)).otherwise(count(t)).cast("string"), F.lit(">")))
    got = {r.document_id: r.summary for r in summarize.summarize(frame, leaf, 100).collect()}
    seen = {i: f"<{len(''.join(t.split()))}>" for i, t in texts.items()}
    assert got == seen


def test_leaves_that_do_not_shorten_end_too(spark):
    frame = spark.createDataFrame([(1, "word and more. " * 400), (2, "bad " * 200), (3, " " * 200)], "document_id long, text string")
    got = {r.document_id: r.summary for r in summarize.summarize(frame, lambda t: F.when(~t.contains("bad"), t), 60).collect()}
    assert set(got) == {1, 2, 3} and 0 < len(got[1]) <= 60 and got[2] is None and got[3] is None
    assert summarize.summarize(frame.where("false"), lambda t: t, 60).count() == 0
