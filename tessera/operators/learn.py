"""Tag classifiers (LR1-8): logistic regression on unit vectors, uncertainty, pseudo labels, overlays."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import l2_normalize
from .writes import sync_tags

#: Label sources that train a model.
TRAINING = ("manual", "seed", "bootstrap", "pseudo")


def label_matrix(labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """LR1: (document_id, label, features)."""
    own = labels.where(F.col("source").isin(*TRAINING)) if "source" in labels.columns else labels
    return (
        own.join(vectors, "document_id")
        .select(
            "document_id",
            F.col("label").cast("double").alias("label"),
            array_to_vector(l2_normalize(F.col("embedding"))).alias("features"),
        )
    )


def train(matrix: DataFrame, c: float = 1.0, rounds: int = 1000):
    """LR2: (weights, intercept, statistics); both classes must occur.

    The objective c * sum(loss) + |w|**2 / 2 becomes Spark's mean loss with
    regParam = 1 / (n * c).
    """
    stat = matrix.agg(F.count("*").alias("n"), F.sum("label").alias("positive")).first()
    if not stat["n"] or not 0 < stat["positive"] < stat["n"]:
        raise ValueError("both classes are needed")
    model = LogisticRegression(maxIter=rounds, regParam=1 / (stat["n"] * c), standardization=False, tol=1e-9).fit(matrix)
    return model.coefficients.toArray().tolist(), model.intercept, {"n": stat["n"], "positive": int(stat["positive"])}


def probability(vector: Column, weights: list[float], intercept: float) -> Column:
    """LR3, as an expression that stays in the JVM."""
    w = F.array(*map(F.lit, weights))
    z = F.aggregate(F.zip_with(l2_normalize(vector), w, lambda a, b: a * b), F.lit(float(intercept)), lambda s, x: s + x)
    return 1 / (1 + F.exp(-z))


def uncertainty_queue(vectors: DataFrame, labels: DataFrame, p: Column, batch: int = 20) -> DataFrame:
    """LR4, ST6: unlabelled documents whose probability is nearest to one half."""
    rest = vectors.join(labels.select("document_id"), "document_id", "left_anti").withColumn("p", p)
    return rest.orderBy(F.abs(F.col("p") - 0.5), "document_id").limit(batch).select("document_id", "p")


def pseudo_labels(vectors: DataFrame, labels: DataFrame, p: Column, high: float = 0.95, low: float = 0.05) -> DataFrame:
    """LR5: (document_id, label) of unlabelled documents that the model is sure of."""
    rest = vectors.join(labels.select("document_id"), "document_id", "left_anti").withColumn("p", p)
    return rest.where((F.col("p") >= high) | (F.col("p") <= low)).select("document_id", (F.col("p") >= high).cast("int").alias("label"))


def apply_learned(overlay: DataFrame, vectors: DataFrame, labels: DataFrame, p: Column, tag: str, threshold: float = 0.5) -> DataFrame:
    """LR6: overlay tags with the learned tag on exactly the unlabelled documents at the threshold or above."""
    scope = vectors.join(labels.select("document_id"), "document_id", "left_anti")
    want = scope.withColumn("p", p).where(F.col("p") >= threshold).select("document_id", F.lit(tag).alias("tag"))
    return sync_tags(overlay, want, "learned", scope, [tag])


def seed_session(tags: DataFrame, folds: DataFrame, vectors: DataFrame, tag: str, negatives: int = 5, seed: int = 0) -> DataFrame:
    """LR7: (document_id, label, source): documents with any spelling of a tag are positive, a few drawn ones negative.

    The draw is the least hashes of (seed, id), so it is the same each time.
    """
    key = folds.where((F.col("raw") == tag) & (F.col("origin") == "source")).select("canonical").distinct()
    raws = folds.where("origin = 'source'").join(key, "canonical", "left_semi").select(F.col("raw").alias("tag"))
    yes = (
        tags.join(raws, "tag", "left_semi")
        .select("document_id")
        .distinct()
        .join(vectors.select("document_id"), "document_id", "left_semi")
    )
    no = (
        vectors.select("document_id")
        .join(yes, "document_id", "left_anti")
        .orderBy(F.xxhash64(F.lit(seed), "document_id"), "document_id")
        .limit(negatives)
    )
    return (
        yes.select("document_id", F.lit(1).alias("label"), F.lit("seed").alias("source"))
        .unionByName(no.select("document_id", F.lit(0).alias("label"), F.lit("bootstrap").alias("source")))
    )


def accept_session(sessions: DataFrame, session_id: int, now: int) -> DataFrame:
    """LR8: this session accepted; an accepted one of the same tag is archived."""
    own = sessions.where(F.col("session_id") == session_id).select(F.col("tag").alias("_tag"))
    rows = sessions.crossJoin(F.broadcast(own.limit(1)))
    this, old = F.col("session_id") == session_id, (F.col("tag") == F.col("_tag")) & (F.col("status") == "accepted")
    return (
        rows.withColumns(
            {
                "status": F.when(this, "accepted").when(old, "archived").otherwise(F.col("status")),
                "accepted_at": F.when(this, F.lit(now).cast("long")).otherwise(F.col("accepted_at")),
            }
        )
        .drop("_tag")
    )
