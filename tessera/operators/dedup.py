"""Document deduplication (DD1-5, DD7-9, ST8): shared keys, components, canonical choice, near candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url, isbn13, normalize_doi
from .graph import connected_components
from .links import merged
from .vectors import similar_pairs

#: Keys in the order in which a link names them (DD5).
KEYS = ("doi", "arxiv_id", "isbn", "url")


def match_keys(docs: DataFrame, url_key: Column | None = None) -> DataFrame:
    """DD1: (id, key, value) of every identifier a document has."""
    value = {
        "doi": normalize_doi(F.col("doi")),
        "arxiv_id": F.lower(F.nullif(F.trim("arxiv_id"), F.lit(""))),
        "isbn": isbn13(F.col("isbn")),
        "url": url_key if url_key is not None else canonical_url(F.col("url_or_path")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), value[k].alias("value")) for k in KEYS])
    return docs.select("id", F.explode(pairs).alias("p")).select("id", "p.key", "p.value").where("value is not null and value <> ''")


def groups(keys: DataFrame, links: DataFrame) -> DataFrame:
    """DD2, DD3: (id, root) of documents connected through shared keys; a merged duplicate stands for its canonical.

    A bucket gives a star to its least member, never all pairs.
    """
    m = merged(links).withColumnRenamed("duplicate_id", "id")
    own = keys.join(m, "id", "left").select(F.coalesce("canonical_id", "id").alias("id"), "key", "value")
    hub = own.groupBy("key", "value").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub <> top").drop("top")
    edges = own.join(hub, ["key", "value"]).select("id", "hub")
    return connected_components(edges, "id", "hub").withColumnRenamed("node", "id")


def canonical_rank(docs: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """ST8: (id, standing): fetched before others, more chunks, earlier ingested, smaller id."""
    n = docs.join(chunk_counts.withColumnRenamed("document_id", "id"), "id", "left")
    state = F.when(F.col("fetch_status") == "fetched", 0).when(F.col("fetch_status") == "unfetchable", 2).otherwise(1)
    return n.select(
        "id",
        F.struct(
            state.alias("s"),
            (-F.coalesce("n_chunks", F.lit(0))).alias("c"),
            F.col("ingested_at").isNull().alias("u"),
            F.col("ingested_at").alias("t"),
            F.col("id").alias("i"),
        )
        .alias("standing"),
    )


def propose_links(members: DataFrame, ranks: DataFrame, keys: DataFrame, links: DataFrame) -> DataFrame:
    """DD4, DD5: (canonical_id, duplicate_id, match_key): each group's members to its best document.

    A pair that was rejected is left out.  match_key is the member's first shared key
    in the order of KEYS.
    """
    best = members.join(ranks, "id").groupBy("root").agg(F.min_by("id", "standing").alias("canonical_id"))
    pairs = members.join(best, "root").where("id <> canonical_id").select("canonical_id", F.col("id").alias("duplicate_id"))
    shared = keys.groupBy("key", "value").agg(F.count_distinct("id").alias("n")).where("n > 1")
    order = F.array_position(F.array(*map(F.lit, KEYS)), F.col("key"))
    first = keys.join(shared, ["key", "value"]).groupBy(F.col("id").alias("duplicate_id")).agg(F.min_by("key", order).alias("match_key"))
    refused = links.where("state = 'rejected'").select("canonical_id", "duplicate_id")
    return (
        pairs.join(refused, ["canonical_id", "duplicate_id"], "left_anti")
        .join(first, "duplicate_id", "left")
        .select("canonical_id", "duplicate_id", "match_key")
    )


def near_candidates(vectors: DataFrame, ranks: DataFrame, links: DataFrame, threshold: float = 0.97, most: int | None = 500) -> DataFrame:
    """DD7: (canonical_id, duplicate_id, score) of the most similar unlinked pairs whose pair isn't known yet."""
    m = merged(links).select(F.col("duplicate_id").alias("document_id"))
    own = vectors.join(m, "document_id", "left_anti").join(ranks.select(F.col("id").alias("document_id"), "standing"), "document_id", "left")
    pairs = similar_pairs(own, "document_id", "embedding", threshold, extra=("standing",))
    known = (
        links.select(
            F.least("canonical_id", "duplicate_id").alias("a"),
            F.greatest("canonical_id", "duplicate_id").alias("b"),
        )
        .distinct()
    )
    fresh = pairs.join(known, ["a", "b"], "left_anti").withColumn("score", F.round("similarity", 4))
    top = fresh if most is None else fresh.orderBy(F.desc("score"), F.desc("a"), F.desc("b")).limit(most)
    first = F.col("a_standing") < F.col("b_standing")
    return top.where("a_standing is not null and b_standing is not null").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical_id"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("duplicate_id"),
        "score",
    )


def scan_report(proposed: DataFrame) -> DataFrame:
    """DD8: links made by key."""
    return proposed.groupBy("match_key").agg(F.count("*").alias("linked"))


def describe(links: DataFrame, docs: DataFrame) -> DataFrame:
    """DD9: links with titles and sources of both sides; a link whose document is gone is left out."""
    side = lambda name: docs.select(F.col("id").alias(f"{name}_id"), F.col("title").alias(f"{name}_title"), F.col("source").alias(f"{name}_source"))
    return links.join(side("canonical"), "canonical_id").join(side("duplicate"), "duplicate_id")


def first_of_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
