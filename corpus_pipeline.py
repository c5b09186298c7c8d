"""The corpus pipeline: five stages of the training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of documents; the last adds the ids of each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.decontaminate import drop_leaks
from tessera.llm.jaccard_join import drop_near_copies
from tessera.llm.quality import THRESHOLD, fit, score_column
from tessera.llm.sentencepiece_codec import encode
from tessera.llm.substring_dedup import substring_dedup
from tessera.plans.ship import shipped


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(score_column(model) >= THRESHOLD)


@shipped
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


@shipped
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too; untouched texts stay as they are.

    A document's other columns travel as one struct, so that none meets a column of the operator.
    """
    others = [c for c in docs.columns if c.lower() != "text"]
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    out = substring_dedup(docs.select(F.col("doc_id"), F.col("text"), F.struct(*map(quoted, others)).alias("own")))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))

    def column(c: str) -> Column:
        if c.lower() == "text":
            return text.alias(c)
        own = F.col("own." + quoted(c))
        return F.when(changed, F.length("kept_text")).otherwise(own).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else own.alias(c)

    return out.select(*map(column, docs.columns))


@shipped
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


@shipped
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their texts, and whether these decode to the text again."""
    rows = encode(docs, decoded="decoded")
    return rows.withColumn("round_trip", F.col("decoded") == F.translate("text", "▁", " ")).drop("decoded")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", sentencepiece),
]

#: SQL can't express the classifier or the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
