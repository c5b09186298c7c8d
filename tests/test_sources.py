from tessera.sources import connectors as X
from tessera.streaming import incremental as I


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_firefox(spark):
    marks = frame(spark, "id long, type int, parent long, fk long, title string, dateAdded long, guid string",
                  (1, 2, 0, None, None, None, "root"), (2, 2, 1, None, "menu", None, "m"), (3, 2, 2, None, "Dev", None, "d"), (4, 2, 1, None, "tags", None, "tags________"), (5, 2, 4, None, "py", None, "x"),
                  (6, 1, 3, 10, " ", 1_700_000_000_000_000, "a"), (7, 1, 2, 10, "again", None, "b"), (8, 1, 5, 10, None, None, "c"), (9, 1, 2, 11, "skip", None, "e"))
    places = frame(spark, "id long, url string, title string", (10, "https://a.org", "Page"), (11, "place:sort=8", None))
    got = X.firefox_bookmarks(marks, places).collect()
    assert [tuple(r) for r in got] == [("6", "https://a.org", "Page", "menu/Dev", ["py"], 1_700_000_000)]


def test_tree_paths_survive_cycles(spark):
    rows = frame(spark, "id long, parent long, title string", (1, 2, "a"), (2, 1, "b"), (3, None, "c"), (4, 3, None), (5, 4, "d"), (6, 6, "self"))
    got = {r.id: r.path for r in X.tree_paths(rows).collect()}
    assert got[3] == "c" and got[5] == "c/d" and got[6] == "self" and len(got[1].split("/")) <= 64


def test_zotero(spark):
    f = lambda s, *r: frame(spark, s, *r)
    t = {
        "items": f("itemID long, key string, itemTypeID long, dateAdded string", (1, "K1", 1, "2020-01-02 03:04:05"), (2, "P1", 2, None), (3, "N1", 3, None)),
        "itemTypes": f("itemTypeID long, typeName string", (1, "journalArticle"), (2, "attachment"), (3, "note")),
        "itemData": f("itemID long, fieldID long, value string", (1, 1, "Title"), (1, 2, "May 2019")), "fields": f("fieldID long, fieldName string", (1, "title"), (2, "date")),
        "itemCreators": f("itemID long, creatorID long, orderIndex int", (1, 2, 1), (1, 1, 0)), "creators": f("creatorID long, firstName string, lastName string", (1, "Ann", "B"), (2, None, "C")),
        "itemTags": f("itemID long, tagID long", (1, 1)), "tags": f("tagID long, name string", (1, "x")),
        "collections": f("collectionID long, parentCollectionID long, collectionName string", (1, None, "Top"), (2, 1, "Sub")), "collectionItems": f("itemID long, collectionID long", (1, 2)),
        "itemAttachments": f("itemID long, parentItemID long, contentType string", (2, 1, "application/pdf")), "itemAnnotations": f("itemID long, parentItemID long, text string, comment string", (4, 2, "hi", " "), (5, 2, None, "c")),
    }
    r = X.zotero_items(t, ["title", "date"]).first()
    assert (r.title, r.year, r.authors, r.tags, r.collections, r.attachment_key, r.annotations, r.date_added) == ("Title", 2019, ["Ann B", "C"], ["x"], ["Top/Sub"], "P1", ["hi", "c"], 1577934245)
    assert [k.key for k in X.zotero_keys(t["items"], t["itemTypes"]).collect()] == ["K1"]


def test_calibre(spark):
    f = lambda s, *r: frame(spark, s, *r)
    link = lambda c, *r: f(f"id long, book long, {c} long", *r)
    t = {
        "books": f("id long, title string, pubdate string, timestamp string", (1, "T", "2001-05-01 00:00:00+00:00", "2020-01-01 00:00:00+00:00")),
        "comments": f("id long, book long, text string", (2, 1, "later"), (1, 1, "first")), "ratings": f("id long, rating int", (1, 8)), "books_ratings_link": link("rating", (1, 1, 1)),
        "authors": f("id long, name string", (1, "A"), (2, "B")), "books_authors_link": link("author", (1, 1, 2), (2, 1, 1)),
        "tags": f("id long, name string", (1, "short"), (2, "a tag of far too many words")), "books_tags_link": link("tag", (1, 1, 1), (2, 1, 2)),
        "publishers": f("id long, name string", (1, "P")), "books_publishers_link": link("publisher", (1, 1, 1)),
    }
    r = X.calibre_books(t).first()
    assert (r.authors, r.tags, r.note, r.publisher, r.comment, r.rating, r.year) == (["B", "A"], ["short"], "a tag of far too many words", "P", "first", 8, 2001)


def test_files(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"id": "x", "n": 1}\nbroken\n{"id": "y", "n": 2}\n')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    assert X.archive_log(spark, str(tmp_path / "log"), schema).count() == 2
    (tmp_path / "img" / "deep").mkdir(parents=True)
    (tmp_path / "img" / "deep" / "p.png").write_bytes(b"x")
    (tmp_path / "img" / "q.txt").write_bytes(b"x")
    assert [r.filename for r in X.image_files(spark, [str(tmp_path / "img")]).collect()] == ["p.png"]
    (tmp_path / "feed.xml").write_text('<feed><entry><id>t3_a</id><title>T</title><updated>2020-01-01T00:00:00+00:00</updated><link href="https://reddit.com/r/sub/comments/a/"/><content>b</content></entry></feed>')
    r = X.reddit_feed(spark, str(tmp_path / "feed.xml")).first()
    assert (r.source_id, r.kind, r.subreddit, r.date_added) == ("t3_a", "post", "sub", 1577836800)
    lists = spark.sql("select 'p' title, array(named_struct('video_id', 'v', 'name', 'n')) items union all select 'q', array(named_struct('video_id', 'v', 'name', 'n'))")
    assert [tuple(r) for r in X.saved_videos(lists).collect()] == [("v", "n", ["p", "q"])]
    assert X.development_cap(lists, 1).count() == 1 and X.development_cap(lists, None).count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "id long, v string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    known, got = spark.createDataFrame([(1, "a")], "id long, v string"), []
    stream = I.read_new(spark, str(tmp_path / "in"), rows.schema)
    q = I.ingest(stream, lambda: known, ["id"], lambda df, n: got.extend(r.id for r in df.collect()), str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert sorted(got) == [2, 3]
    seen = []
    I.on_arrival(stream, [lambda df: df.where("id > 1").distinct()], lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "c2")).awaitTermination(60)
    assert sorted(seen) == [2, 3]
    timed = spark.sql("select timestamp'2024-01-01 10:00:00' ts, 1L k, 'x' v union all select timestamp'2024-01-01 11:00:00', 1L, 'x' union all select timestamp'2024-01-05 11:00:00', 1L, 'y'")
    timed.coalesce(1).write.parquet(str(tmp_path / "t"))
    s = I.read_new(spark, str(tmp_path / "t"), timed.schema)
    for name, out in (("changed", I.changed_items(s, "k", ["v"])), ("windows", I.windowed_counts(s, "v"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
    assert spark.table("changed").count() == 2
    assert [tuple(r)[1:] for r in spark.table("windows").collect()] == [("x", 2)]
