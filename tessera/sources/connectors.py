"""Source readers as joins over the sources' own tables (SC1-19).

Each takes DataFrames of the source's tables (read by JDBC, from Parquet, or from
exported JSON), so that reading and shaping stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import calibre_year, iso_seconds, zotero_year
from ..operators.graph import cut

#: Levels of a folder tree that are followed.
DEPTH = 32
TAG_ROOT = "tags________"
LONG_TAG_WORDS = 4


def jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str | None = None,
    bounds: tuple[int, int] | None = None,
    parts: int = 8,
) -> DataFrame:
    """A table of a relational source, read in ranges of a numeric column where one is named."""
    options = {"url": url, "dbtable": table}
    if column and bounds:
        options |= {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


def _present(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def tree_paths(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """SC2, SC6: (id, path) of folders (id, parent, title): titles from the root down, joined by slashes.

    Every round lifts all unfinished chains at once by doubling, so a depth of 32
    takes five joins; a cycle ends where the depth ends.  Rounds are checkpointed, so that
    the plan doesn't double with them, and end once no chain is open.
    """
    own = nodes.select(
        "id",
        F.when(F.col("parent") != F.col("id"), F.col("parent")).alias("up"),
        F.coalesce("title", F.lit("")).alias("title"),
    )
    up = own.select(F.col("id").alias("up"), F.lit(1).alias("known"))
    rows = own.join(up, "up", "left").select("id", F.when(F.col("known") == 1, F.col("up")).alias("up"), F.array("title").alias("parts"))
    reach, rows = 1, cut(rows)
    while reach < depth and not rows.where(F.col("up").isNotNull()).isEmpty():
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("parts").alias("higher"))
        parts = F.when(F.col("higher").isNull(), F.col("parts")).otherwise(F.concat("higher", "parts"))
        rows = cut(rows.join(above, "up", "left").select("id", F.col("next").alias("up"), parts.alias("parts")))
        reach *= 2
    return rows.select("id", F.array_join(F.filter(F.col("parts"), lambda p: p != ""), "/").alias("path"))


def firefox_bookmarks(bookmarks: DataFrame, places: DataFrame) -> DataFrame:
    """SC1-3: bookmarks, one for each url (the first), with folder path and tags."""
    folders = bookmarks.where("type = 2")
    paths = tree_paths(folders.select("id", "parent", "title")).select(F.col("id").alias("parent"), F.col("path").alias("folder_path"))
    root = bookmarks.where(F.col("guid") == TAG_ROOT).select(F.col("id").alias("parent"))
    tag_folders = folders.join(root, "parent", "left_semi").select(F.col("id").alias("parent"), F.col("title").alias("tag"))
    tags = (
        bookmarks.where("type = 1")
        .join(tag_folders, "parent")
        .groupBy(F.col("fk").alias("place_id"))
        .agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    )
    p = places.select(F.col("id").alias("place_id"), "url", F.col("title").alias("page_title"))
    own = (
        bookmarks.where("type = 1")
        .join(p, F.col("fk") == F.col("place_id"))
        .where("url not ilike 'place:%' and url not ilike 'javascript:%'")
    )
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("id"))).where("_n = 1")
    out = first.join(paths, "parent", "left").join(tags, "place_id", "left")
    return out.select(
        F.col("id").cast("string").alias("source_id"), "url", F.coalesce(_present("title"), _present("page_title"), "url").alias("title"),
        F.coalesce("folder_path", F.lit("")).alias("folder_path"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.when(F.col("dateAdded") != 0, F.floor(F.col("dateAdded") / 1_000_000)).alias("date_added"),
    )


def zotero_items(t: dict[str, DataFrame], fields: list[str]) -> DataFrame:
    """SC4-8: items that aren't attachments, notes or annotations, with fields, authors, tags, collections, first PDF and annotations."""
    kinds = t["itemTypes"].where("typeName not in ('attachment', 'note', 'annotation')")
    items = t["items"].join(kinds, "itemTypeID").select("itemID", "key", F.col("typeName").alias("item_type"), "dateAdded")
    data = t["itemData"].join(t["fields"], "fieldID").groupBy("itemID").pivot("fieldName", fields).agg(F.first("value"))
    people = (
        t["itemCreators"]
        .join(t["creators"], "creatorID")
        .groupBy("itemID")
        .agg(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct("orderIndex", F.trim(F.concat_ws(" ", "firstName", "lastName")).alias("name"))
                    )
                ),
                lambda s: s["name"],
            )
            .alias("authors")
        )
    )
    tags = t["itemTags"].join(t["tags"], "tagID").groupBy("itemID").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    paths = tree_paths(
        t["collections"].select(
            F.col("collectionID").alias("id"),
            F.col("parentCollectionID").alias("parent"),
            F.col("collectionName").alias("title"),
        )
    )
    shelves = (
        t["collectionItems"]
        .join(paths, F.col("collectionID") == F.col("id"))
        .groupBy("itemID")
        .agg(F.array_sort(F.collect_set("path")).alias("collections"))
    )
    keys = t["items"].select(F.col("itemID").alias("attachmentID"), F.col("key").alias("attachment_key"))
    pdf = (
        t["itemAttachments"]
        .where("contentType = 'application/pdf'")
        .select(F.col("itemID").alias("attachmentID"), F.col("parentItemID").alias("itemID"))
        .join(keys, "attachmentID")
    )
    first_pdf = pdf.groupBy("itemID").agg(F.min_by("attachment_key", "attachmentID").alias("attachment_key"))
    notes = t["itemAnnotations"].join(
        pdf.select("attachmentID", F.col("itemID").alias("ownerID")),
        F.col("parentItemID") == F.col("attachmentID"),
    )
    annotated = (
        notes.withColumn("note", F.concat_ws("\n\n", _present("text"), _present("comment")))
        .where("note <> ''")
        .groupBy(F.col("ownerID").alias("itemID"))
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(notes["itemID"].alias("n"), F.col("note")))),
                lambda s: s["note"],
            )
            .alias("annotations")
        )
    )
    out = items
    for side in (data, people, tags, shelves, first_pdf, annotated):
        out = out.join(side, "itemID", "left")
    if "date" in fields:
        out = out.withColumn("year", zotero_year(F.col("date")))
    return out.withColumn("date_added", iso_seconds(F.col("dateAdded"))).drop("dateAdded")


def zotero_keys(items: DataFrame, types: DataFrame) -> DataFrame:
    """SC7: the keys alone; a scan of three columns."""
    return items.join(types.where("typeName not in ('attachment', 'note', 'annotation')"), "itemTypeID").select("key")


def split_long_tags(tags: Column, most: int = LONG_TAG_WORDS) -> tuple[Column, Column]:
    """SC10: tags of up to ``most`` words, and the longer ones as lines of a note (null if there are none)."""
    words = lambda t: F.size(F.split(F.trim(t), r"\s+"))
    return F.filter(tags, lambda t: words(t) <= most), F.nullif(F.array_join(F.filter(tags, lambda t: words(t) > most), "\n"), F.lit(""))


def calibre_books(t: dict[str, DataFrame]) -> DataFrame:
    """SC9: books with first comment and rating, authors, tags, publisher and series."""
    def linked(link: str, names: str, column: str, out: str) -> DataFrame:
        return (
            t[link]
            .join(t[names].select(F.col("id").alias(column), "name"), column)
            .groupBy("book")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda s: s["name"]).alias(out))
        )

    comment = t["comments"].groupBy("book").agg(F.min_by("text", "id").alias("comment"))
    rating = (
        t["books_ratings_link"]
        .join(
            t["ratings"].select(F.col("id").alias("rating_id"), F.col("rating").alias("stars")),
            F.col("rating") == F.col("rating_id"),
        )
        .groupBy("book")
        .agg(F.min_by("stars", "id").alias("rating"))
    )
    sides = [
        comment,
        rating,
        linked("books_authors_link", "authors", "author", "authors"),
        linked("books_tags_link", "tags", "tag", "all_tags"),
        linked("books_publishers_link", "publishers", "publisher", "publishers"),
    ]
    out = t["books"].withColumnRenamed("id", "book")
    for side in sides:
        out = out.join(side, "book", "left")
    tags, note = split_long_tags(F.col("all_tags"))
    return out.select(
        F.col("book").alias("source_id"),
        "title",
        "authors",
        tags.alias("tags"),
        note.alias("note"),
        F.element_at("publishers", 1).alias("publisher"),
        "comment",
        "rating",
        calibre_year(F.col("pubdate")).alias("year"),
        iso_seconds(F.col("timestamp")).alias("date_added"),
    )


def image_files(spark: SparkSession, folders: list[str], patterns: tuple = ("*.jpg", "*.jpeg", "*.png", "*.webp", "*.gif")) -> DataFrame:
    """SC11: (path, filename, file_size, modified) of images below the folders; contents aren't read."""
    rows = (
        spark.read
        .format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + ",".join(patterns) + "}")
        .load(folders)
    )
    return rows.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("file_size"),
        F.unix_timestamp("modificationTime").alias("modified"),
    )


def reddit_feed(spark: SparkSession, path: str) -> DataFrame:
    """SC12: saved items of archived Atom pages."""
    entry = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("updated", T.StringType()),
            T.StructField("content", T.StringType()),
            T.StructField("link", T.StructType([T.StructField("_href", T.StringType())])),
        ]
    )
    rows = spark.read.format("xml").option("rowTag", "entry").schema(entry).load(path)
    kind = F.when(F.col("id").startswith("t1_"), "comment").when(F.col("id").startswith("t3_"), "post").otherwise("other")
    return rows.select(
        F.col("id").alias("source_id"),
        kind.alias("kind"),
        "title",
        F.col("link._href").alias("permalink"),
        F.nullif(F.regexp_extract("link._href", "/r/([^/]+)/", 1), F.lit("")).alias("subreddit"),
        iso_seconds(F.col("updated")).alias("date_added"),
        F.col("content").alias("body"),
    )


def archive_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SC13: the lines of a JSONL archive that parse."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest_items(log: DataFrame, key: str, line: str = "line_no") -> DataFrame:
    """SC14: each item's latest version, with ``first_seen`` for the order."""
    whole = F.struct(*[c for c in log.columns])
    return log.groupBy(key).agg(F.max_by(whole, line).alias("_w"), F.min(line).alias("first_seen")).select("_w.*", "first_seen")


def saved_videos(playlists: DataFrame) -> DataFrame:
    """SC15: one row a video of exported playlists (title, items), with the playlists it is in."""
    items = playlists.select(F.col("title").alias("playlist"), F.explode("items").alias("i")).select("playlist", "i.*")
    rest = [c for c in items.columns if c not in ("playlist", "video_id")]
    return items.groupBy("video_id").agg(*[F.min(c).alias(c) for c in rest], F.array_sort(F.collect_set("playlist")).alias("playlists"))


def page_groups(pages: DataFrame, size: int = 10) -> DataFrame:
    """SC16: (document_id, section_index, page_start, page_end, text): found pages in groups by their place."""
    found = pages.where(F.trim("text") != "")
    placed = found.withColumn(
        "section_index",
        F.floor((F.row_number().over(Window.partitionBy("document_id").orderBy("page")) - 1) / size).cast("int"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: F.trim(s["text"])), "\n\n")
    return (
        placed.groupBy("document_id", "section_index")
        .agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), text.alias("text"))
    )


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """SC18: a fixed list of files; later writes to the folder aren't seen."""
    return spark.read.parquet(*spark.read.parquet(path).inputFiles())


def development_cap(rows: DataFrame, n: int | None) -> DataFrame:
    """SC19: the first n rows of a source in development, all if n is null."""
    return rows if n is None else rows.limit(n)
