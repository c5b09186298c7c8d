"""Clustering (CL1-15, IN2-3, SK13, HP19): k-means family substitutes for the tree and density methods, labelled as such."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import adaptive_cluster_params, l2_normalize
from ..functions.text import body_excerpt, label_from_texts, label_to_tag
from .links import merged
from .vectors import mean_vectors, nearest_centroid


def candidates(docs: DataFrame, chunks: DataFrame, links: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """CL1: documents with chunks, without merged duplicates."""
    own = docs.where(F.col("source").isin(sources)) if sources else docs
    own = own.join(chunks.select(F.col("document_id").alias("id")), "id", "left_semi")
    return own.join(merged(links).select(F.col("duplicate_id").alias("id")), "id", "left_anti")


def _features(vectors: DataFrame, unit: bool = True) -> DataFrame:
    v = l2_normalize(F.col("embedding")) if unit else F.transform("embedding", lambda x: x.cast("double"))
    return vectors.withColumn("features", array_to_vector(v))


def reduce_pca(vectors: DataFrame, k: int = 50) -> DataFrame:
    """CL2, CL8: vectors centred and projected on their first components; with k=2 the plane that stands in for UMAP."""
    rows = _features(vectors, unit=False)
    head = vectors.select(F.size("embedding").alias("d")).first()
    n = vectors.count()
    k = max(2, min(k, n - 1, head["d"])) if head else 2
    centred = StandardScaler(inputCol="features", outputCol="c", withMean=True, withStd=False).fit(rows).transform(rows)
    out = PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred)
    return out.withColumn("embedding", vector_to_array("p")).drop("features", "c", "p")


def auto_k(
    vectors: DataFrame, low: int = 8, high: int = 40, tries: int = 8, tolerance: float = 1e-3, seed: int = 42
) -> tuple[int, list[tuple[int, float]]]:
    """CL5: the number of clusters of best silhouette among geometrically spaced ones; near ties go to the smaller."""
    rows = _features(vectors).persist()
    n = rows.count()
    high = min(high, max(2, n - 1))
    low = min(low, high)
    ks = sorted({min(high, max(2, round(low * (high / low) ** (i / max(1, tries - 1))))) for i in range(tries)})
    judge = ClusteringEvaluator(metricName="silhouette", distanceMeasure="cosine")
    scores = [(k, judge.evaluate(KMeans(k=k, seed=seed, distanceMeasure="cosine").fit(rows).transform(rows))) for k in ks]
    rows.unpersist()
    best = max(s for _, s in scores)
    return next(k for k, s in scores if s >= best - tolerance), scores


def cluster(vectors: DataFrame, k: int | None = None, seed: int = 42) -> DataFrame:
    """CL3, CL4 (substitute): (document_id, cluster_id) of level 1 by k-means on unit vectors."""
    k = k or auto_k(vectors, seed=seed)[0]
    rows = _features(vectors)
    return (
        KMeans(k=k, seed=seed, distanceMeasure="cosine")
        .fit(rows)
        .transform(rows)
        .select("document_id", F.col("prediction").cast("long").alias("cluster_id"))
    )


def split_clusters(vectors: DataFrame, level1: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """CL6, CL7 (substitute): (document_id, parent_id, cluster_id) of level 2 by bisecting k-means inside each parent.

    A parent under the minimum cluster size, or that yields one part, isn't split.
    The loop is over parents (tens), each a distributed fit.
    """
    least = adaptive_cluster_params(n or vectors.count())[0]
    sizes = level1.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * least).orderBy("cluster_id").collect()
    out = None
    for r in sizes:
        rows = _features(
            vectors.join(
                level1.where(F.col("cluster_id") == r["cluster_id"]).select("document_id"),
                "document_id",
                "left_semi",
            )
        )
        parts = (
            BisectingKMeans(k=max(2, min(8, r["n"] // least)), seed=seed, minDivisibleClusterSize=float(least))
            .fit(rows)
            .transform(rows)
        )
        own = parts.select("document_id", F.lit(r["cluster_id"]).alias("parent_id"), F.col("prediction").cast("long").alias("cluster_id"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        return level1.select("document_id", F.col("cluster_id").alias("parent_id"), "cluster_id").where("false")
    return out


def run_tables(level1: DataFrame, vectors: DataFrame, run_id: int, now: int, first_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """SK13: (clusters, assignments) of a run; a negative cluster is the noise bucket, which has no centroid."""
    means = mean_vectors(
        level1.where("cluster_id >= 0").join(vectors, "document_id"),
        "cluster_id",
    ).withColumnRenamed("embedding", "centroid")
    ids = (
        level1.select("cluster_id")
        .distinct()
        .withColumn("_id", (F.row_number().over(Window.orderBy("cluster_id")) + F.lit(first_id - 1)).cast("long"))
    )
    clusters = (
        ids.join(means, "cluster_id", "left")
        .select(
            F.col("_id").alias("cluster_id"),
            F.lit(run_id).cast("long").alias("run_id"),
            F.lit(1).cast("long").alias("level"),
            "centroid",
            (F.col("cluster_id") < 0).alias("is_noise"),
            F.lit(now).cast("long").alias("created_at"),
        )
    )
    rows = (
        level1.join(ids, "cluster_id")
        .select(
            "document_id",
            F.col("_id").alias("cluster_id"),
            F.lit(run_id).cast("long").alias("run_id"),
            F.lit(1).cast("long").alias("level"),
            F.lit(now).cast("long").alias("assigned_at"),
        )
    )
    return clusters, rows


def label_samples(assignments: DataFrame, docs: DataFrame, n: int = 8) -> DataFrame:
    """CL9: (cluster_id, texts): title and excerpt of a cluster's first documents."""
    own = assignments.join(
        docs.select(
            F.col("id").alias("document_id"),
            F.concat_ws(" ", "title", body_excerpt(F.col("body"), entities=False)).alias("t"),
        ),
        "document_id",
    )
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("cluster_id").orderBy("document_id"))).where(F.col("_n") <= n)
    return first.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "t"))), lambda s: s["t"]).alias("texts"))


def label_clusters(samples: DataFrame) -> DataFrame:
    """CL10 with AG24: (cluster_id, label) from the samples' most frequent words."""
    return samples.select("cluster_id", label_from_texts(F.col("texts")).alias("label"))


def active_run(runs: DataFrame) -> DataFrame:
    """CL15: (run_id) of the accepted run; of several the highest."""
    return runs.where("accepted").agg(F.max("run_id").alias("run_id")).where("run_id is not null")


def accept_run(runs: DataFrame, run_id: int) -> DataFrame:
    """CL15: this run accepted, all others not."""
    return runs.withColumn("accepted", F.col("run_id") == run_id)


def listed(clusters: DataFrame, assignments: DataFrame) -> DataFrame:
    """ST4: clusters with their number of documents: noise last, then by level, parent (none first), most documents, id."""
    n = assignments.groupBy("cluster_id").agg(F.count("*").alias("doc_count"))
    own = clusters.join(n, "cluster_id", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0).cast("long")))
    return own.orderBy("is_noise", "level", F.coalesce("parent_id", F.lit(0)), F.desc("doc_count"), "cluster_id")


def assign_new(
    vectors: DataFrame,
    assignments: DataFrame,
    centroids1: DataFrame,
    centroids2: DataFrame,
    noise_id: int | None,
    floor: float = 0.0,
) -> DataFrame:
    """IN2: (document_id, cluster_id, level, score) of documents that have no cluster yet.

    First the nearest level-1 centroid (below the floor the noise bucket, or nothing
    without one), then the nearest of its children.
    """
    fresh = vectors.join(assignments.select("document_id"), "document_id", "left_anti")
    one = nearest_centroid(fresh, centroids1)
    kept = one.where(F.col("score") >= floor)
    out = kept.withColumn("level", F.lit(1))
    if noise_id is not None:
        out = out.unionByName(
            one.where(F.col("score") < floor)
            .select("document_id", F.lit(noise_id).cast("long").alias("cluster_id"), "score")
            .withColumn("level", F.lit(1))
        )
    kids = centroids2.select(F.col("cluster_id").alias("child"), "parent_id", l2_normalize(F.col("embedding")).alias("c"))
    own = (
        kept.join(fresh.select("document_id", l2_normalize(F.col("embedding")).alias("v")), "document_id")
        .join(kids, F.col("cluster_id") == F.col("parent_id"))
    )
    scored = own.select(
        "document_id",
        "child",
        F.aggregate(F.zip_with("v", "c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"),
    )
    two = (
        scored.groupBy("document_id")
        .agg(F.max(F.struct("score", (-F.col("child")).alias("m"))).alias("b"))
        .select(
            "document_id",
            (-F.col("b.m")).alias("cluster_id"),
            F.col("b.score").alias("score"),
            F.lit(2).alias("level"),
        )
    )
    return out.unionByName(two)


def needs_full_run(has_run: bool, same_model: bool, new: int, placed: int, share: float = 0.2) -> bool:
    """IN3: whether a full run is due: none yet, another embedding model, or many new documents."""
    return not has_run or not same_model or new > share * max(placed, 1)


def label_overlays(assignments: DataFrame, clusters: DataFrame) -> DataFrame:
    """CL13: (document_id, tag, origin) of cluster labels; the noise bucket has none."""
    own = (
        clusters.where(~F.col("is_noise"))
        .select(
            "cluster_id",
            label_to_tag(F.col("label"), F.col("cluster_id")).alias("tag"),
            F.concat(F.lit("cluster_l"), F.col("level").cast("string")).alias("origin"),
        )
    )
    return assignments.select("document_id", "cluster_id").join(own, "cluster_id").select("document_id", "tag", "origin").distinct()


def scatter(runs: DataFrame, assignments: DataFrame, docs: DataFrame) -> DataFrame:
    """CL14: (document_id, x, y, cluster_id, title) of a run's stored points."""
    points = (
        runs.select(
            F.explode(F.from_json("umap_points", "array<struct<document_id:bigint,x:double,y:double>>")).alias("p")
        )
        .select("p.*")
    )
    own = assignments.where("level = 1").select("document_id", "cluster_id")
    return points.join(own, "document_id", "left").join(docs.select(F.col("id").alias("document_id"), "title"), "document_id", "left")


def purge_run(runs: DataFrame, clusters: DataFrame, assignments: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """HP19: the three tables without a run."""
    keep = F.col("run_id") != run_id
    return runs.where(keep), clusters.where(keep), assignments.where(keep)
