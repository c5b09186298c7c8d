"""Connected components over an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Without that setting a folder of this machine serves in local mode, where driver and
    executors are one; on a cluster it is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{shared_base(spark)}/tessera-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the session's shared checkpoint folder and cut its lineage."""
    shared_base(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table below the shared checkpoint folder, for rounds that read what the last round left.

    It cuts lineage as ``cut`` does.  But a checkpoint keeps the size that was estimated for the
    plan behind it, and a join's estimate is the product of its sides: when each round joins what
    the last one left with itself, the estimate's digits double every round, and planning soon
    takes longer than running (14 rounds: over 100,000 digits).  A table's size is that of its files.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str) -> DataFrame:
    """Rows numbered from 0 in an order, whatever their number.

    They are dealt out by ranges of the order, sorted in place and checkpointed, so that numbers
    stay as they are if a task runs again; a number is the rows of the ranges before (one count
    for each, the only thing the driver sees) and the place in its own.
    """
    at = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in at.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(p, 0)
    ahead = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), (part + 1).cast("int"))
    return at.withColumn(name, ahead + F.col("_at") - F.shiftleft(part, 33)).drop("_at")


#: A node with more neighbours than this, and than 1 / 100,000 of all edges, is joined by a broadcast.
CROWDED = 512


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node of its component.

    Alternates large-star and small-star steps, which take a logarithmic number of
    rounds whatever the diameter, until every edge leads from a node that has no other
    to a root; edges that do so from the start take no round.  Each round reduces to
    minima before it joins, so that a hub's neighbours are never held together.  A hub's
    edges meet its minimum by a broadcast of the hubs (100,000 rows at most), so that none
    of them is dealt by the hub.

    The edges and the end of each round are checkpointed, steps inside a round are not: their
    plans share exchanges, and every checkpoint is a file for each partition (on a local
    folder, also a process started by the executor).
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null")
    given = cut(e.distinct())
    e = given.where("u <> v")
    while True:
        ends = (
            e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .union(e.select("v", F.lit(0), F.lit(1)))
            .groupBy("x")
            .agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        )
        size, unsettled = ends.agg(F.sum("up"), F.count_if(F.expr("up > 1 or up = 1 and down = 1"))).first()
        if not unsettled:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n")).select("x", F.least("x", "m").alias("m"), "n")
        crowd = max(CROWDED, 2 * size // 100_000)
        hubs = F.broadcast(least.where(F.col("n") > crowd).drop("n"))
        few = both.join(hubs, "x", "left_anti").join(least.where(F.col("n") <= crowd).drop("n"), "x")
        met = both.join(hubs, "x").unionByName(few)
        large = met.where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(root.select("u", F.col("m").alias("v"))).distinct())
    nodes = given.select(F.col("u").alias("node")).union(given.select("v")).distinct()
    return nodes.join(e.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("root"))
