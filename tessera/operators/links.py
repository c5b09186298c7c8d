"""Duplicate links (FL4, FL6, JN4, JN5, RK12, SK14, DD6): one hop deep, read as joins on an owner id.

``links`` has canonical_id, duplicate_id, state and whatever else describes a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(links: DataFrame) -> DataFrame:
    """(duplicate_id, canonical_id) of the links in force."""
    return links.where("state = 'merged'").select("duplicate_id", "canonical_id")


def with_owner(rows: DataFrame, links: DataFrame, key: str = "document_id", owner: str = "owner_id") -> DataFrame:
    """JN5: ``rows`` with the document that ``key`` reads as: its canonical, or itself."""
    m = merged(links).withColumnsRenamed({"duplicate_id": "_d", "canonical_id": "_c"})
    return rows.join(m, F.col(key) == F.col("_d"), "left").withColumn(owner, F.coalesce("_c", key)).drop("_d", "_c")


def exclude_duplicates(docs: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """FL6."""
    return docs.join(merged(links).select(F.col("duplicate_id").alias(key)), key, "left_anti")


def source_in(docs: DataFrame, links: DataFrame, sources: list[str]) -> DataFrame:
    """FL4: documents of these sources, and canonicals of a duplicate of these sources."""
    own = docs.where(F.col("source").isin(sources)).select("id")
    through = own.join(merged(links), F.col("id") == F.col("duplicate_id")).select(F.col("canonical_id").alias("id"))
    return docs.join(own.union(through).distinct(), "id", "left_semi")


def linked_copies(docs: DataFrame, links: DataFrame) -> DataFrame:
    """RK12: (document_id, copy_id, source, title) for every document and each other one of its group."""
    m = merged(links)
    members = m.select(F.col("canonical_id").alias("owner"), F.col("duplicate_id").alias("id"))
    members = members.union(m.select(F.col("canonical_id").alias("owner"), F.col("canonical_id").alias("id"))).distinct()
    other = members.select("owner", F.col("id").alias("copy_id"))
    pairs = members.join(other, "owner").where("id <> copy_id").select(F.col("id").alias("document_id"), "copy_id")
    return pairs.join(docs.select(F.col("id").alias("copy_id"), "source", "title"), "copy_id")


def listed(rows: DataFrame, state: str | None = None) -> DataFrame:
    """ST3: links, or aliases, by score, unscored last; ties by id."""
    own = rows if state is None else rows.where(F.col("state") == state)
    return own.orderBy(F.col("score").desc_nulls_last(), "id")


def link(links: DataFrame, asked: DataFrame) -> DataFrame:
    """DD6, SK14: ``links`` after the links asked for (canonical_id, duplicate_id, match_key) are made.

    A canonical resolves through the links in force, the duplicates of a new
    duplicate move to its canonical, and a link it had is kept as rejected.  Of
    several canonicals asked for one duplicate the least wins; chains among the
    links asked for end at their common canonical; asking for a cycle or for
    oneself changes nothing.  The result is materialised, so that a write on top of
    a write doesn't plan both again.
    """
    from .graph import connected_components, cut

    old = merged(links)
    want = with_owner(
        asked.where("canonical_id <> duplicate_id"),
        links,
        "canonical_id",
        "c",
    ).select("duplicate_id", F.col("c").alias("canonical_id"), "match_key")
    want = want.where("canonical_id <> duplicate_id")
    first = Window.partitionBy("duplicate_id").orderBy("canonical_id", "match_key")
    want = cut(want.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"))
    parts = cut(connected_components(want, "canonical_id", "duplicate_id"))
    heads = (
        want.select("canonical_id")
        .distinct()
        .join(want.select(F.col("duplicate_id").alias("canonical_id")), "canonical_id", "left_anti")
    )
    top = heads.join(parts, F.col("canonical_id") == F.col("node")).groupBy("root").agg(F.min("canonical_id").alias("head"))
    new = cut(
        want.join(parts, F.col("duplicate_id") == F.col("node"))
        .join(top, "root")
        .where("head <> duplicate_id")
        .select(F.col("head").alias("canonical_id"), "duplicate_id", "match_key")
    )
    moved = (
        old.join(
            new.select(F.col("duplicate_id").alias("canonical_id"), F.col("canonical_id").alias("head")),
            "canonical_id",
        )
        .where("head <> duplicate_id")
    )
    moved = (
        moved.select(F.col("head").alias("canonical_id"), "duplicate_id", F.lit("manual").alias("match_key"))
        .join(new.select("duplicate_id"), "duplicate_id", "left_anti")
        .select("canonical_id", "duplicate_id", "match_key")
    )
    made = cut(new.unionByName(moved).withColumn("state", F.lit("merged")))
    touched = made.select("duplicate_id").distinct().withColumn("_t", F.lit(True))
    kept = (
        links.join(touched, "duplicate_id", "left")
        .join(made.select("canonical_id", "duplicate_id"), ["canonical_id", "duplicate_id"], "left_anti")
    )
    kept = kept.withColumn("state", F.when(F.col("_t") & (F.col("state") == "merged"), "rejected").otherwise(F.col("state"))).drop("_t")
    return cut(kept.unionByName(made, allowMissingColumns=True))
