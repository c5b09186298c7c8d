"""Cutting retained texts anew (RC1, RC2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_text, embed_text, token_count
from .browse import body_chunk


def cut_blocks(blocks: DataFrame) -> DataFrame:
    """RC2: (document_id, place, text, chunk_pass, page_start, page_end): the chunks of text blocks.

    ``blocks``: (document_id, block, text, fallback, chunk_pass, page_start, page_end).  A
    block that gives no chunk becomes its fallback, whole, unless that is blank.  All
    chunks of a block carry its pass and pages; ``place`` numbers a document's chunks
    from 0, in order of blocks.
    """
    found = chunk_text(F.col("text"))
    whole = F.nullif(F.trim("fallback"), F.lit(""))
    parts = F.when(F.size("_found") > 0, F.col("_found")).when(whole.isNotNull(), F.array(whole)).otherwise(F.array().cast("array<string>"))
    rows = (
        blocks.withColumn("_found", found)
        .select(
            "document_id",
            "block",
            "chunk_pass",
            "page_start",
            "page_end",
            F.posexplode(parts).alias("part", "text"),
        )
    )
    order = Window.partitionBy("document_id").orderBy("block", "part")
    return (
        rows.withColumn("place", F.row_number().over(order) - 1)
        .select("document_id", "place", "text", "chunk_pass", "page_start", "page_end")
    )


def retained_blocks(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """RC1: the blocks that retained texts (document_id, text, blocks, truncated) are replayed as.

    A text with a block map goes section by section, with the sections' pages; another goes
    as it was embedded, behind title and card summary.  Blank texts, and texts that were cut
    when they were stored, give nothing.
    """
    own = (
        texts.where((F.trim("text") != "") & ~F.col("truncated"))
        .join(docs.select(F.col("id").alias("document_id"), "title", "card_summary"), "document_id")
    )
    mapped = own.where(F.size("blocks") > 0).select("document_id", "text", F.explode("blocks").alias("b"))
    section = F.substring(F.col("text"), F.col("b.offset") + 1, F.col("b.length"))
    none = F.lit(None)
    sections = mapped.select(
        "document_id",
        F.col("b.index").cast("long").alias("block"),
        section.alias("text"),
        none.cast("string").alias("fallback"),
        F.lit("fulltext").alias("chunk_pass"),
        F.col("b.page_start").cast("long").alias("page_start"),
        F.col("b.page_end").cast("long").alias("page_end"),
    )
    body = embed_text(F.col("title"), F.col("card_summary"), F.col("text"))
    rest = (
        own.where(F.coalesce(F.size("blocks"), F.lit(0)) <= 0)
        .select(
            "document_id",
            F.lit(0).cast("long").alias("block"),
            body.alias("text"),
            body.alias("fallback"),
            none.cast("string").alias("chunk_pass"),
            none.cast("long").alias("page_start"),
            none.cast("long").alias("page_end"),
        )
    )
    return sections.unionByName(rest)


def rechunk(docs: DataFrame, texts: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RC1: the chunk table after all retained texts are cut anew, and (document_id, removed, added, first_index).

    New chunks are numbered on from the highest index that a document has; its old body
    chunks go only if it got new ones, enrichment chunks stay.
    """
    fresh = cut_blocks(retained_blocks(docs, texts))
    top = chunks.groupBy("document_id").agg(F.max("chunk_index").alias("_top"))
    fresh = (
        fresh.join(top, "document_id", "left")
        .withColumn("chunk_index", (F.coalesce(F.col("_top") + 1, F.lit(0)) + F.col("place")).cast("long"))
    )
    fresh = fresh.withColumn("token_count", token_count(F.col("text"))).drop("_top", "place")
    per = fresh.groupBy("document_id").agg(F.count("*").alias("added"), F.min("chunk_index").alias("first_index"))
    old = chunks.where(body_chunk()).join(per.select("document_id"), "document_id", "left_semi")
    gone = old.groupBy("document_id").agg(F.count("*").alias("removed"))
    kept = chunks.join(old.select("id"), "id", "left_anti")
    report = (
        per.join(gone, "document_id", "left")
        .select("document_id", F.coalesce("removed", F.lit(0).cast("long")).alias("removed"), "added", "first_index")
    )
    return kept.unionByName(fresh, allowMissingColumns=True), report
