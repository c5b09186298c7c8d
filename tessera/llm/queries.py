"""The registered queries of this subpackage: thin wrappers over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode

    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.translate("text", "\u2581", " ")).alias("round_trip"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens, edit_counts, load_ranks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    start = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.length(F.coalesce("text", F.lit(""))) + 1).cast("int")
    edits = docs.select(
        "doc_id",
        F.lit(1).alias("seq"),
        start.alias("start"),
        (start + 9).alias("end"),
        F.lit(" edited 2 words").alias("replacement"),
    )
    ranks = load_ranks(docs)
    index = count_tokens(docs, ranks=ranks).withColumn("n_before", F.col("n_tokens"))
    return edit_counts(index, edits, ranks=ranks).select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), "recut")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_leaks(docs, table(spark, sf_dir, "benchmark")).drop("th")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_texts

    out = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "class_id", "copy_id", "n_links")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"), 8)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    out = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") + F.col("n_b") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return out.withColumn("groups_sha256", digest).drop("groups")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
