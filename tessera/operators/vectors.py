"""Vector operators (JN9-11, AG13-14, FN31, CL11-12): similarity joins, nearest centroids, means, drift, merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import cosine, dot, l2_normalize
from .blocks import met, packed
from .graph import written

#: Vectors in one block of a similarity join.
BLOCK = 1024
#: Regions that a similarity join tells apart at most; their table of pairs is what bounds them.
PIVOTS = 512


def mean_vectors(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """AG13, AG14: (key, embedding): the mean of each key's vectors, in double precision; partial sums before the shuffle."""
    at = rows.select(key, F.posexplode(vector).alias("pos", "x"))
    means = at.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(vector))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vector_id", vector: str = "embedding") -> DataFrame:
    """JN11: (key, similarity) of the k vectors nearest to one query by cosine, exactly; a running top-k, no sort of all."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("similarity", cosine(F.col(vector), q)).orderBy(F.desc("similarity"), key).limit(k)


def _apart(near: np.ndarray, reach: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs of regions that may hold a pair at the threshold, by the triangle inequality of angles."""
    angle = np.arccos(np.clip(near @ near.T, -1, 1))
    limit = np.arccos(np.clip(threshold, -1, 1)) + reach[:, None] + reach[None, :] + 1e-6
    return [(int(i), int(j)) for i, j in np.argwhere(angle <= limit) if i <= j]


def _nearest_pivot(near: np.ndarray, extra: tuple[str, ...]):
    """Adds the nearest pivot (of ties the least) and its cosine, a batch as one matrix product."""

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            dots = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) @ near.T
            r = dots.argmax(1)
            kept = [batch.column(c) for c in ("k", "v", *extra)]
            new = [pa.array(r.astype(np.int32)), pa.array(dots[np.arange(len(r)), r])]
            yield pa.RecordBatch.from_arrays(kept + new, ["k", "v", *extra, "r", "s"])

    return run


def _pairs(threshold: float, extra: tuple[str, ...]):
    """The pairs of two blocks at the threshold or above, the lesser key first."""

    def work(pairs):
        for b, left, b2, right in pairs:
            s = _matrix(left) @ _matrix(right).T
            row, col = np.nonzero(s >= threshold)
            a, z = left.column("k").combine_chunks().take(pa.array(row)), right.column("k").combine_chunks().take(pa.array(col))
            less = pc.less(a, z)
            if b == b2:
                keep = less.to_numpy(zero_copy_only=False)
                row, col, a, z, less = row[keep], col[keep], a.filter(less), z.filter(less), less.filter(less)
            out = {"a": pc.if_else(less, a, z), "b": pc.if_else(less, z, a), "similarity": pa.array(s[row, col])}
            for c in extra:
                one, two = left.column(c).combine_chunks().take(pa.array(row)), right.column(c).combine_chunks().take(pa.array(col))
                out |= {f"a_{c}": pc.if_else(less, one, two), f"b_{c}": pc.if_else(less, two, one)}
            for at in range(0, len(row), 1 << 16):
                yield pa.table({c: v.slice(at, 1 << 16) for c, v in out.items()})

    return work


def _matrix(t: pa.Table) -> np.ndarray:
    v = t.column("v").combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def similar_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, block: int = BLOCK, pivots: int = PIVOTS, extra: tuple[str, ...] = ()) -> DataFrame:
    """JN9: (a, b, similarity), a < b, of all pairs with cosine at the threshold or above; columns ``extra`` of both as a_..., b_....

    Vectors go to the nearest of some pivots (vectors with the least hashes of their keys),
    and two regions are compared only if their pivots' angle, less what both regions reach
    out, allows a pair: exact, whatever the data, and the closer the more they cluster.
    Regions are cut into blocks by a hash; a task multiplies two blocks, so it holds two
    blocks whatever the table's size (``blocks``), and no vector is dealt to all blocks.  Only
    pairs that pass leave it.  Vectors that are
    null, zero, of another length than most, or hold null or non-finite components have no
    pairs.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in extra}
    schema = ", ".join([f"a {kind}, b {kind}, similarity double", *[f"a_{c} {t}, b_{c} {t}" for c, t in kinds.items()]])
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    own = vectors.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"), *extra).where(usable)
    shape = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if shape is None:
        return spark.createDataFrame([], schema)
    own = own.where(F.size("v") == shape["d"]).withColumn("v", l2_normalize(F.col("v"), 0.0))
    several = min(pivots, shape["n"] // block)
    if several > 1:
        picked = own.orderBy(F.xxhash64("k"), "k").limit(several).select("v").collect()
        near = np.array([r["v"] for r in picked])
        more = "".join(f", {c} {t}" for c, t in kinds.items())
        own = own.mapInArrow(_nearest_pivot(near, extra), f"k {kind}, v array<double>{more}, r int, s double")
        counted = own.groupBy("r").agg(F.count("*").alias("n"), F.min("s").alias("s")).collect()
        held = {r["r"]: (r["n"], float(np.arccos(np.clip(r["s"], -1, 1)))) for r in counted}
    else:  # one region, which needs no pivot
        near, own, held = np.ones((1, 1)), own.withColumn("r", F.lit(0)), {0: (shape["n"], np.pi)}
    parts = [max(1, -(-held[i][0] // block)) if i in held else 0 for i in range(len(near))]
    first = np.concatenate(([0], np.cumsum(parts)[:-1])).tolist()
    reach = np.array([held[i][1] if i in held else 0.0 for i in range(len(near))])
    meets: dict[int, list[int]] = {i: [] for i in held}
    for i, j in _apart(near, reach, threshold):
        if i in held and j in held:
            meets[i].append(j)
            if i != j:
                meets[j].append(i)
    # A row for each region: its first block, how many it has, and the regions that it may have pairs with.
    grid = F.broadcast(spark.createDataFrame([(i, first[i], parts[i], meets[i]) for i in meets], "r int, low int, n int, others array<int>"))
    placed = own.join(grid.select("r", "low", "n"), "r")
    blocks = packed(placed.select("k", "v", *extra, "low", "n"), F.col("low") + F.pmod(F.xxhash64("k"), F.col("n")))
    # Two blocks meet once, in one of both orders by turns, so that all have as many to meet.
    even = (F.col("block") + F.col("block_2")) % 2 == 0
    once = (F.col("block") == F.col("block_2")) | F.when(F.col("block") < F.col("block_2"), ~even).otherwise(even)
    if any(len(m) < len(held) for m in meets.values()):
        within = (F.col("block") >= F.col("low")) & (F.col("block") < F.col("low") + F.col("n"))
        blocks = written(blocks.join(grid, within).select("block", "data", "r", "others"))
        once = once & F.array_contains("others", F.col("r_2"))
    return met(blocks, blocks, (sum(parts), sum(parts)), shape["n"] * 8 * (shape["d"] + 8), _pairs(threshold, extra), schema, once)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str = "document_id", most: int = 10_000) -> DataFrame:
    """JN10: (key, cluster_id, score): the centroid of highest cosine, ties to the lowest id.

    Centroids (a run has tens) are packed into one broadcast row, and a vector finds its
    best in place.  More than ``most`` make several such rows, whose bests are compared.
    """
    c = centroids.select("cluster_id", l2_normalize(F.col("embedding")).alias("c"))
    packs = -(-centroids.count() // most)
    packed = (
        c.groupBy(F.pmod(F.xxhash64("cluster_id"), F.lit(max(packs, 1))))
        .agg(F.collect_list(F.struct("cluster_id", "c")).alias("pack"))
        .select("pack")
    )
    score = lambda p: F.struct(dot(F.col("v"), p["c"]).alias("score"), (-p["cluster_id"]).alias("m"))
    scored = (
        vectors.select(key, l2_normalize(F.col("embedding")).alias("v"))
        .join(F.broadcast(packed))
        .select(key, F.array_max(F.transform("pack", score)).alias("best"))
    )
    if packs > 1:
        scored = scored.groupBy(key).agg(F.max("best").alias("best"))
    return scored.select(key, (-F.col("best.m")).alias("cluster_id"), F.col("best.score").alias("score"))


def drift(centroids: DataFrame, assigned: DataFrame, vectors: DataFrame, threshold: float = 0.60) -> DataFrame:
    """CL11: (cluster_id, drift_score, n_recent, flagged): 1 - mean cosine of recent members to their centroid.

    ``assigned``: (document_id, cluster_id) of members newer than the run.  A cluster
    without recent members scores 0; one whose recent members have no vectors is left out.
    """
    near = assigned.join(vectors.select("document_id", l2_normalize(F.col("embedding")).alias("v")), "document_id", "left")
    near = near.join(centroids.select("cluster_id", l2_normalize(F.col("embedding")).alias("c")), "cluster_id")
    per = near.groupBy("cluster_id").agg(F.count("*").alias("n_recent"), (1 - F.avg(dot(F.col("v"), F.col("c")))).alias("d"))
    out = centroids.select("cluster_id").join(per, "cluster_id", "left").where("n_recent is null or d is not null")
    d = F.coalesce("d", F.lit(0.0))
    return out.select(
        "cluster_id",
        F.round(d, 3).alias("drift_score"),
        F.coalesce("n_recent", F.lit(0)).alias("n_recent"),
        (d > threshold).alias("flagged"),
    )


def merge_suggestions(centroids: DataFrame, threshold: float = 0.85) -> DataFrame:
    """CL12: (cluster_id_a, cluster_id_b, similarity) of centroid pairs at the threshold or above."""
    pairs = similar_pairs(centroids, "cluster_id", "embedding", threshold)
    return pairs.select(F.col("a").alias("cluster_id_a"), F.col("b").alias("cluster_id_b"), F.round("similarity", 3).alias("similarity"))


def readable(vectors: DataFrame, size: int) -> DataFrame:
    """SK18: vectors that are present, whole and finite; a broken one doesn't cost the others."""
    v = F.col("embedding")
    return vectors.where(v.isNotNull() & (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))

