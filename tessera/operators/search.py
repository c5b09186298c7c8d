"""Search and fusion (RK1-7, RK9-10, SO3): hits are (doc_id, similarity, rank); rank is explicit, from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import numbered
from .links import merged
from .vectors import top_k

#: Chunks fetched for one page of hits.
OVERFETCH, MOST = 3, 1000
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _ranked(hits: DataFrame, *order) -> DataFrame:
    """Ranks from 1 for hits that a top-k or a page bounds: one window over all of them."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def _ranked_widely(hits: DataFrame, *order) -> DataFrame:
    """Ranks from 1 for any number of hits, from sorted ranges."""
    return numbered(hits, *order, name="rank").withColumn("rank", F.col("rank") + 1)


def semantic_hits(chunks: DataFrame, query: list[float], limit: int = 20, offset: int = 0, sources: list[str] | None = None) -> DataFrame:
    """RK1: the best chunk of each document among the top chunks; chunks (vector_id, document_id, source, embedding)."""
    if sources:
        chunks = chunks.where(F.col("source").isin(sources))
    near = top_k(chunks, query, min((offset + limit) * OVERFETCH, MOST))
    hits = near.groupBy(F.col("document_id").alias("doc_id")).agg(F.max("similarity").alias("similarity"))
    return _ranked(hits, F.desc("similarity"), "doc_id")


def image_text_hits(chunks: DataFrame, query: list[float], n: int) -> DataFrame:
    """RK9: documents of image chunks by their nearest chunk."""
    near = top_k(chunks.where("source = 'image'"), query, max(3 * n, 10))
    hits = near.groupBy(F.col("document_id").alias("doc_id")).agg(F.max("similarity").alias("similarity"))
    return _ranked(hits, F.desc("similarity"), "doc_id").where(F.col("rank") <= n)


def _phrase_count(text: Column, phrase: str) -> Column:
    """Occurrences of a phrase, overlapping ones too, ignoring case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_count(low, F.lit(f"(?=\\Q{phrase.lower()}\\E)"))


def bm25(rows: DataFrame, columns: list[str], phrase: str) -> DataFrame:
    """``rows`` that hold the phrase, with ``score`` (lower is better): trigram-index BM25 of one phrase over the columns.

    Frequency counts overlapping occurrences in all columns, length is the number of
    trigrams, and document count and mean length are over the whole table.
    """
    size = sum(
        (F.greatest(F.lit(0), F.length(F.coalesce(c, F.lit(""))) - 2) for c in columns[1:]),
        F.greatest(F.lit(0), F.length(F.coalesce(columns[0], F.lit(""))) - 2),
    )
    found = sum((_phrase_count(F.col(c), phrase) for c in columns[1:]), _phrase_count(F.col(columns[0]), phrase))
    counted = rows.withColumns({"_d": size, "_f": found})
    whole = counted.agg(F.count("*").alias("_n"), F.sum((F.col("_f") > 0).cast("int")).alias("_m"), F.avg("_d").alias("_avg"))
    idf = F.greatest(F.log((F.col("_n") - F.col("_m") + 0.5) / (F.col("_m") + 0.5)), F.lit(LEAST_IDF))
    score = -idf * F.col("_f") * (K1 + 1) / (F.col("_f") + K1 * (1 - B + B * F.col("_d") / F.col("_avg")))
    return counted.where("_f > 0").crossJoin(F.broadcast(whole)).withColumn("score", score).drop("_d", "_f", "_n", "_m", "_avg")


def keyword_hits(docs: DataFrame, chunks: DataFrame, query: str, sources: list[str] | None = None, heads=None, bodies=None) -> DataFrame:
    """RK2, RK3: title and card matches first, then matches in chunks by the best one; similarity is null.

    ``heads`` and ``bodies`` are text indexes of titles and cards by document id, and of chunk
    texts by chunk id; without them the tables are scanned.  A query under three characters
    matches titles like a pattern, in order of id.
    """
    query = query.strip()
    own = docs.where(F.col("source").isin(sources)) if sources else docs
    if len(query) < 3:
        hits = (
            own.where(F.col("title").ilike(f"%{query}%"))
            .select(F.col("id").alias("doc_id"), F.lit(0).alias("tier"), F.col("id").cast("double").alias("score"))
        )
    else:
        keep = own.select(F.col("id").alias("doc_id"))
        if heads:
            head = heads.bm25(query).withColumnRenamed("row_id", "id")
        else:
            head = bm25(docs, ["title", "card_summary"], query)
        head = head.select(F.col("id").alias("doc_id"), F.lit(0).alias("tier"), "score")
        if bodies:
            found = chunks.select(F.col("id").alias("row_id"), "document_id").join(bodies.bm25(query), "row_id")
        else:
            found = bm25(chunks, ["text"], query)
        body = (
            found
            .groupBy(F.col("document_id").alias("doc_id"))
            .agg(F.min("score").alias("score"))
            .select("doc_id", F.lit(1).alias("tier"), "score")
        )
        both = head.unionByName(body).groupBy("doc_id").agg(F.min(F.struct("tier", "score")).alias("b"))
        hits = both.select("doc_id", "b.tier", "b.score").join(keep, "doc_id", "left_semi")
    ranked = _ranked_widely(hits, "tier", "score", "doc_id")
    return ranked.select("doc_id", F.lit(None).cast("double").alias("similarity"), "rank")


def append_new(first: DataFrame, more: DataFrame) -> DataFrame:
    """SO3, RK4: the first arm's hits, then those of the other that it doesn't have, in their order.

    The first arm is bounded by its top-k, so its size, and the ranks of the other arm's
    hits that it has too, fit one broadcast row; a hit's new rank follows from them.
    """
    own = first.select("doc_id", F.lit(True).alias("_own"))
    shared = more.join(F.broadcast(own), "doc_id", "left_semi").agg(F.sort_array(F.collect_list("rank")).alias("_gone"))
    size = first.agg(F.count("*").alias("_size"))
    rest = more.join(F.broadcast(own), "doc_id", "left_anti").join(F.broadcast(shared)).join(F.broadcast(size))
    earlier = F.size(F.filter("_gone", lambda r: r < F.col("rank")))
    moved = rest.select("doc_id", "similarity", (F.col("_size") + F.col("rank") - earlier).alias("rank"))
    return first.select("doc_id", "similarity", "rank").unionByName(moved)


def hybrid(semantic: DataFrame, keyword: DataFrame, mode: str = "hybrid") -> DataFrame:
    """RK4: keywords run in their modes, or where the semantic arm finds nothing."""
    if mode == "fulltext":
        return keyword
    if mode == "semantic":
        none = semantic.limit(1).agg(F.count("*").alias("_n"))
        return append_new(semantic, keyword.crossJoin(F.broadcast(none)).where("_n = 0").drop("_n"))
    return append_new(semantic, keyword)


def merge_clip(hits: DataFrame, clip: DataFrame) -> DataFrame:
    """RK5: the better of both scores; scored hits by score, then unscored ones in their order."""
    c = clip.select("doc_id", F.col("similarity").alias("s2"), F.col("rank").alias("r2"))
    both = (
        hits.join(c, "doc_id", "full")
        .select(
            "doc_id",
            F.greatest("similarity", "s2").alias("similarity"),
            F.coalesce("rank", F.col("r2") + 1_000_000_000).alias("r"),
        )
    )
    return _ranked_widely(both, F.col("similarity").desc_nulls_last(), "r", "doc_id").select("doc_id", "similarity", "rank")


def fold_duplicates(hits: DataFrame, links: DataFrame) -> DataFrame:
    """RK6: each hit as its canonical; the best score, at the place of whichever came first."""
    m = merged(links).withColumnRenamed("duplicate_id", "doc_id")
    own = hits.join(m, "doc_id", "left").withColumn("target", F.coalesce("canonical_id", "doc_id"))
    best = own.groupBy(F.col("target").alias("doc_id")).agg(F.max("similarity").alias("similarity"), F.min("rank").alias("r"))
    return _ranked_widely(best, "r").select("doc_id", "similarity", "rank")


def paginate(hits: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """RK7: a page of the filtered hits with ``total``, their number."""
    top = hits.withColumnRenamed("rank", "r").orderBy("r").limit(offset + limit)
    total = hits.agg(F.count("*").alias("total"))
    return _ranked(top, "r").drop("r").where(F.col("rank") > offset).join(F.broadcast(total))


def merge_image_hits(clip: DataFrame, text: DataFrame) -> DataFrame:
    """RK10: (doc_id, similarity, matched_by): the better similarity of both arms."""
    t = text.select("doc_id", F.col("similarity").alias("t"))
    both = clip.select("doc_id", F.col("similarity").alias("c")).join(t, "doc_id", "full")
    how = F.when(F.col("c").isNotNull() & F.col("t").isNotNull(), "clip+text").when(F.col("c").isNotNull(), "clip").otherwise("text")
    return both.select("doc_id", F.round(F.greatest("c", "t"), 3).alias("similarity"), how.alias("matched_by"))
