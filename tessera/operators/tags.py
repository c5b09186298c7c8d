"""Tag folding, counts and fold candidates (AG1-3, AG15-18, TF1-8, ST2-3, SO1, SO2).

Usage tables are (document_id, tag, origin); ``aliases`` is (alias, canonical, state, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tag_key
from .links import with_owner

#: Origins with a closed vocabulary, to which aliases don't apply (TF2).
CLOSED = ("inferred",)
# Words that end like plurals and aren't.
NOT_PLURAL = (
    "physics mathematics economics statistics linguistics politics ethics news series species analysis basis thesis crisis bus "
    "gas lens chaos cosmos corpus status virus glasses business process access class less"
).split()


def usage(source_tags: DataFrame, overlay_tags: DataFrame) -> DataFrame:
    """SO1: both kinds of tags as (document_id, tag, origin)."""
    own = source_tags.select("document_id", F.col("tag_string").alias("tag"), F.lit("source").alias("origin"))
    return own.unionByName(overlay_tags.select("document_id", "tag", "origin"))


def fold_table(used: DataFrame, aliases: DataFrame, key: Column | None = None) -> DataFrame:
    """AG3, TF1, TF2: (origin, raw, n, key, canonical, display) of every spelling in use."""
    counts = used.groupBy("origin", F.col("tag").alias("raw")).agg(F.countDistinct("document_id").alias("n"))
    keyed = counts.withColumn("key", F.coalesce(F.nullif(key if key is not None else tag_key(F.col("raw")), F.lit("")), "raw"))
    active = aliases.where("state = 'active'").select(F.col("alias").alias("key"), F.col("canonical").alias("_to"))
    canonical = F.when(F.col("origin").isin(*CLOSED), F.col("key")).otherwise(F.coalesce("_to", "key"))
    folded = keyed.join(active, "key", "left").withColumn("canonical", canonical).drop("_to")
    best = Window.partitionBy("origin", "canonical").orderBy(F.desc("n"), "raw")
    return folded.withColumn("display", F.first("raw").over(best)).select("origin", "raw", "n", "key", "canonical", "display")


def tag_counts(used: DataFrame, folds: DataFrame, links: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """AG1, AG2: (tag, origin, count, variants): distinct items a folded tag is on.

    Counted by (origin, canonical) at once, so a document with two spellings counts
    once and a duplicate counts as its canonical.  ``scope``: ids that may count.
    """
    owned = with_owner(used, links).join(folds.select("origin", F.col("raw").alias("tag"), "canonical", "display", "n"), ["origin", "tag"])
    if scope is not None:
        owned = owned.join(scope.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    names = F.array_sort(F.collect_set(F.struct((-F.col("n")).alias("n"), F.col("tag").alias("t"))))
    out = (
        owned.groupBy("origin", "canonical")
        .agg(F.min("display").alias("tag"), F.countDistinct("owner_id").alias("count"), names.alias("v"))
    )
    return out.select("tag", "origin", "count", F.transform("v", lambda s: s["t"]).alias("variants"))


def listed(counts: DataFrame, q: str | None = None, limit: int = 100) -> DataFrame:
    """ST2: most used first, source tags before others on a tie."""
    if q:
        counts = counts.where(F.exists("variants", lambda v: F.contains(F.lower(v), F.lit(q.lower()))))
    return counts.orderBy(F.desc("count"), F.col("origin") != "source", "tag", "origin").limit(limit)


def inventory(folds: DataFrame, aliases: DataFrame) -> DataFrame:
    """AG17: (key, n): uses summed over origins; closed vocabularies and folded keys are left out."""
    folded = aliases.where("state = 'active'").select(F.col("alias").alias("key"))
    own = folds.where(~F.col("origin").isin(*CLOSED) & (F.col("key") != ""))
    return own.join(folded, "key", "left_anti").groupBy("key").agg(F.sum("n").alias("n"))


def variant_report(folds: DataFrame) -> DataFrame:
    """AG18: (origin, tag, variants, documents) of tags with more than one spelling."""
    names = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("raw").alias("t"))))
    out = folds.groupBy("origin", "canonical").agg(F.min("display").alias("tag"), names.alias("v"), F.sum("n").alias("documents"))
    return out.where(F.size("v") > 1).select("origin", "tag", F.transform("v", lambda s: s["t"]).alias("variants"), "documents")


def _directed(pairs: DataFrame) -> DataFrame:
    """TF6: the more used key is canonical, ties to the first in the alphabet."""
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return pairs.select(
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("alias"),
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical"),
    )


def morphology_pairs(tags: DataFrame) -> DataFrame:
    """TF3: (alias, canonical) of plurals and singulars among the keys; an equi-join on the derived singular."""
    last, n = F.element_at(F.split("key", "-"), -1), F.length("key")
    cut = lambda k: F.expr(f"substring(key, 1, length(key) - {k})")
    single = (
        F.when(last.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(last.rlike("(?:ses|xes|ches|shes)$"), cut(2))
        .when(last.endswith("s") & ~last.endswith("ss"), cut(1))
    )
    plural = (
        tags.where((F.length(last) >= 4) & ~last.isin(NOT_PLURAL) & (n > 0))
        .select(F.col("key").alias("a"), F.col("n").alias("na"), single.alias("b"))
    )
    return _directed(plural.join(tags.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b"))


def initialism_pairs(tags: DataFrame) -> DataFrame:
    """TF4: (alias, canonical) of short keys that spell the initials of a longer one."""
    words = F.filter(F.split("key", "-"), lambda w: w != "")
    long = (
        tags.where(F.size(words) >= 2)
        .select(
            F.col("key").alias("canonical"),
            F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "").alias("alias"),
        )
    )
    short = tags.where(F.col("key").rlike(r"^\p{L}{2,5}$")).select(F.col("key").alias("alias"))
    return short.join(long, "alias").select("alias", "canonical")


def semantic_pairs(tags: DataFrame, vectors: DataFrame, threshold: float = 0.92, least: int = 2, most: int | None = 5000) -> DataFrame:
    """TF5: (alias, canonical, score) of much-used keys whose vectors (key, embedding) are alike; ``most`` None: all of them."""
    from .vectors import similar_pairs

    top = tags.where(F.col("n") >= least)
    top = top if most is None else top.orderBy(F.desc("n"), "key").limit(most)
    pairs = similar_pairs(vectors.join(top, "key"), "key", "embedding", threshold)
    n = top.select("key", "n")
    full = pairs.join(n.withColumnsRenamed({"key": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"key": "b", "n": "nb"}), "b")
    scored = full.withColumn("score", F.round("similarity", 4))
    first = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return scored.select(
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("alias"),
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical"),
        "score",
    )


def scan(found: list[tuple[str, DataFrame]], aliases: DataFrame) -> DataFrame:
    """TF7: (alias, canonical, kind) of new pairs; a pair known in any state or direction is out, the first kind wins."""
    rows = None
    for turn, (kind, pairs) in enumerate(found):
        part = pairs.select("alias", "canonical", F.lit(kind).alias("kind"), F.lit(turn).alias("turn"))
        rows = part if rows is None else rows.unionByName(part)
    key = lambda df: df.withColumns({"lo": F.least("alias", "canonical"), "hi": F.greatest("alias", "canonical")})
    fresh = key(rows).join(key(aliases).select("lo", "hi").distinct(), ["lo", "hi"], "left_anti")
    first = Window.partitionBy("lo", "hi").orderBy("turn", "alias")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("alias", "canonical", "kind")


def documents_of(spellings: DataFrame, source_tags: DataFrame, overlay_tags: DataFrame) -> DataFrame:
    """SO2: (document_id) of documents that carry one of the spellings (tag) in either table, each once."""
    own = source_tags.select("document_id", F.col("tag_string").alias("tag")).union(overlay_tags.select("document_id", "tag"))
    return own.join(spellings.select("tag").distinct(), "tag", "left_semi").select("document_id").distinct()


def describe_aliases(aliases: DataFrame, folds: DataFrame, used: DataFrame, docs: DataFrame, examples: int = 3) -> DataFrame:
    """TF8: each alias row with its labels, totals and up to three example titles."""
    per = (
        folds.where(~F.col("origin").isin(*CLOSED))
        .groupBy("key")
        .agg(F.max_by("raw", F.struct("n", F.col("raw"))).alias("label"), F.sum("n").alias("total"))
    )
    titles = (
        used.join(folds.select("origin", F.col("raw").alias("tag"), "key"), ["origin", "tag"])
        .select("key", "document_id")
        .distinct()
        .join(docs.select(F.col("id").alias("document_id"), "title"), "document_id")
    )
    some = (
        titles.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("document_id")))
        .where(F.col("_n") <= examples)
        .groupBy("key")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("document_id", "title"))), lambda s: s["title"])
            .alias("titles")
        )
    )
    out = aliases
    for side in ("alias", "canonical"):
        named = per.select(F.col("key").alias(side), F.col("label").alias(f"{side}_label"), F.col("total").alias(f"{side}_total"))
        out = out.join(named, side, "left")
    return out.join(some.withColumnRenamed("key", "alias"), "alias", "left")


def path_tag_counts(paths: DataFrame, most: int = 1000) -> DataFrame:
    """AG15: (tag, n, over): documents of each collection tag, counted a (document, source) pair; ``over`` the cap."""
    return paths.groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n")).withColumn("over", F.col("n") > most)


def path_tag_stats(paths: DataFrame, top: int = 5) -> DataFrame:
    """AG16: documents, rows, distinct tags and the most used tags of each source."""
    per = paths.groupBy("source", "tag").agg(F.count("*").alias("n"))
    best = (
        per.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "tag")))
        .where(F.col("_n") <= top)
        .groupBy("source")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "tag"))), lambda s: s["tag"]).alias("top"))
    )
    return (
        paths.groupBy("source")
        .agg(
            F.countDistinct("document_id").alias("documents"),
            F.count("*").alias("rows"),
            F.countDistinct("tag").alias("tags"),
        )
        .join(best, "source", "left")
    )
