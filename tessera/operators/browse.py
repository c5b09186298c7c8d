"""Browse filters, listings and cards (FL1-3, FL5, FL7-10, FL19-20, JN3, JN6-8, JN12-13, ST1, SO4, RK8, RK11, AG25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .links import exclude_duplicates, source_in, with_owner

#: Chunk passes that are no body text (FL10).
ENRICHMENT = ("summary", "external_synopsis", "metadata")
#: Columns of a card; the vector stays behind (FL20).
CARD = ("id", "source", "source_id", "title", "url_or_path", "archive_url", "date_added", "fetch_status", "item_type", "card_summary", "doi", "year")


def body_chunk() -> Column:
    """FL10: a chunk of body text."""
    return F.col("chunk_pass").isNull() | ~F.col("chunk_pass").isin(*ENRICHMENT)


def having_tag(docs: DataFrame, tags: DataFrame, folds: DataFrame, links: DataFrame, wanted: list[str]) -> DataFrame:
    """FL2, FL3: documents that carry all wanted tags, each through any spelling and any linked duplicate.

    ``tags``: (document_id, tag); ``folds``: (raw, canonical) of the spellings in use.
    """
    spark, wanted = folds.sparkSession, sorted(set(wanted))
    if not wanted:
        return docs
    asked = F.broadcast(spark.createDataFrame(list(enumerate(wanted)), "turn int, raw string"))
    keys = (
        folds.select("raw", "canonical")
        .join(asked, "raw")
        .select("turn", "canonical")
        .union(asked.select("turn", F.col("raw").alias("canonical")))
        .distinct()
    )
    owned = (
        with_owner(tags, links)
        .join(folds, F.col("tag") == F.col("raw"), "left")
        .select("owner_id", F.coalesce("canonical", "tag").alias("canonical"))
    )
    met = (
        owned.join(keys, "canonical")
        .groupBy(F.col("owner_id").alias("id"))
        .agg(F.countDistinct("turn").alias("n"))
        .where(F.col("n") == len(wanted))
    )
    return docs.join(met.select("id"), "id", "left_semi")


def wayback_only(docs: DataFrame) -> DataFrame:
    """FL5."""
    return docs.where("source = 'firefox' and archive_url is not null")


def exclude_pending_images(docs: DataFrame, images: DataFrame) -> DataFrame:
    """FL7: documents of images that aren't indexed yet stay hidden."""
    return docs.join(images.where("indexed_at is null").select(F.col("document_id").alias("id")), "id", "left_anti")


def browse(docs: DataFrame, links: DataFrame, images: DataFrame, sources: list[str] | None = None, wayback: bool = False) -> DataFrame:
    """FL1: visible documents under the filters."""
    if sources:
        docs = source_in(docs, links, sources)
    if wayback:
        docs = wayback_only(docs)
    return exclude_duplicates(exclude_pending_images(docs, images), links)


def page(docs: DataFrame, limit: int = 48, offset: int = 0) -> DataFrame:
    """ST1: newest first, undated last."""
    return docs.orderBy(F.col("date_added").desc_nulls_last(), F.desc("id")).offset(offset).limit(limit)


def restrict_hits(
    hits: DataFrame,
    docs: DataFrame,
    assignments: DataFrame | None = None,
    clusters: list[int] | None = None,
    statuses: list[str] | None = None,
    date_from: int | None = None,
    date_to: int | None = None,
) -> DataFrame:
    """FL8, FL9: hits (doc_id, similarity, rank) of documents that pass; an unknown document is dropped.

    Dates are inclusive and a missing date counts as 0; a bound of 0 is no bound.
    Membership is in any level of the active run.
    """
    rows = docs.select(F.col("id").alias("doc_id"), "fetch_status", F.coalesce("date_added", F.lit(0)).alias("_date"))
    if statuses:
        rows = rows.where(F.col("fetch_status").isin(statuses))
    if date_from:
        rows = rows.where(F.col("_date") >= date_from)
    if date_to:
        rows = rows.where(F.col("_date") <= date_to)
    if clusters:
        own = assignments.where(F.col("cluster_id").isin(clusters)) if assignments is not None else docs.where("false").withColumn("document_id", F.col("id"))
        rows = rows.join(own.select(F.col("document_id").alias("doc_id")), "doc_id", "left_semi")
    return hits.join(rows.select("doc_id"), "doc_id", "left_semi")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """JN6: (document_id, text) of each document's first chunk."""
    return chunks.groupBy("document_id").agg(F.min_by("text", "chunk_index").alias("text"))


def cards(docs: DataFrame, chunks: DataFrame, tags: DataFrame, assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """JN7, RK8: documents with description, sorted tags, chunk count and first-level cluster.

    Each side is reduced to a row a document before it is joined.
    """
    from ..functions.text import resolve_description

    size = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.min_by("text", "chunk_index").alias("_first"))
    own = tags.groupBy("document_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    placed = (
        assignments.where("level = 1")
        .join(clusters.select("cluster_id", "label"), "cluster_id")
        .groupBy("document_id")
        .agg(F.min("label").alias("cluster"))
    )
    out = docs
    for side in (size, own, placed):
        out = out.join(side.withColumnRenamed("document_id", "id"), "id", "left")
    return (
        out.withColumn("description", resolve_description(F.col("card_summary"), F.col("_first"), entities=False))
        .drop("_first")
        .withColumns(
            {"n_chunks": F.coalesce("n_chunks", F.lit(0)), "tags": F.coalesce("tags", F.array().cast("array<string>"))}
        )
    )


def detail(docs: DataFrame, chunks: DataFrame, tags: DataFrame, assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """RK11: cards with the document's enrichment items, none as an empty list."""
    items = enrichment(chunks).withColumnRenamed("document_id", "id")
    kind = "array<struct<chunk_index:bigint,chunk_pass:string,text:string>>"
    return (
        cards(docs, chunks, tags, assignments, clusters)
        .join(items, "id", "left")
        .withColumn("items", F.coalesce(F.col("items").cast(kind), F.array().cast(kind)))
    )


def enrichment(chunks: DataFrame) -> DataFrame:
    """AG25: (document_id, items) of summary and synopsis chunks in order."""
    own = chunks.where(F.col("chunk_pass").isin("summary", "external_synopsis"))
    return own.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_pass", "text"))).alias("items"))


def reading_list(items: DataFrame, docs: DataFrame) -> DataFrame:
    """JN12: a list's documents by position."""
    return items.join(docs, F.col("document_id") == F.col("id")).orderBy("list_id", "position", "document_id")


def images_listed(images: DataFrame, kind: str | None = None) -> DataFrame:
    """FL19: indexed images, by id."""
    rows = images.where("indexed_at is not null")
    return (rows.where(F.col("image_type") == kind) if kind else rows).orderBy("id")


def images_of_hits(hits: DataFrame, images: DataFrame, key: str = "clip_vector_id") -> DataFrame:
    """JN8: the images of ranked hits (by vector or by document), rank kept."""
    return hits.join(images, key).orderBy("rank", "id")


def unfetchable_log(docs: DataFrame, log: DataFrame) -> DataFrame:
    """JN13: a row for each log entry of unfetchable documents."""
    return docs.where("fetch_status = 'unfetchable'").join(log, F.col("id") == F.col("document_id"))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
