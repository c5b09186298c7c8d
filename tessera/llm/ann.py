"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors go to the posting lists of nearby centroids: always the nearest, and, for
vectors near a boundary, up to REPLICAS - 1 more within a distance ratio.  Queries
find centroids by a best-first walk over an in-memory neighbour graph and search
every list whose centroid lies within a pruning ratio of the nearest.  The ratio is
calibrated when the index is fitted: the least that reaches TARGET recall against
brute force on the sample, where neighbours are sparser than in the whole, so
harder to reach.  Inner product becomes distance by one more coordinate that gives
every vector the largest norm.

Centroids come from a bounded sample (SAMPLE distinct vectors in the order of a
hash of their ids) by k-means with a penalty on full clusters; every vector is
indexed.  Equal rows (id and vector) count once.  A list larger than CHUNK is cut
into chunks by a hash of id and vector, and all its chunks are searched, so a group
of copies, or of vectors of one id, spreads over tasks whatever its size; queries to
a list are chunked by id.  Within a chunk, everything within a hair of the k-th best
id's product is scored again row by row in double precision, so ties are settled by
id alone.

An outlier of very great norm makes all other vectors look alike after that, and the
calibrated ratio then searches most lists: slower, not worse.

Plan: the driver sees the sample, the centroids and one count for each list, all
bounded by parameters; vectors are shuffled once a replica.  A chunk answers a
query with one packed row of its k best at most; these are merged for each query,
in two steps where the grid of chunks is large.

Defined cases: vectors that are null, zero or hold null or non-finite components,
of another length than most, or without an id take no part; rows of a query's own
id are no candidates; an id that is stored more than once is reported once, with
its best score, and asks once, with its least vector; fewer candidates than k give
fewer rows; incoming columns beyond id and vector aren't looked at.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SAMPLE = 20_000
MAX_LISTS = 4096
REPLICAS, BOUNDARY = 2, 1.10
LINKS = 16
TARGET = 0.97
CHUNK = 4096
#: Answers of chunks that are merged at once for a query; answers in a slot of merged queries, about.
MERGED, SLOT = 4096, 4096
#: Pairs scored again at a time.
PAIRS = 50_000


def valid(v: Column) -> Column:
    """Whether a vector may take part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """Centroids, their graph and the ratios; what tasks need of the index."""

    centroids: np.ndarray  # with the coordinate that evens norms
    graph: np.ndarray
    norm: float
    ratio: float

    def even(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that gives all of them the largest norm."""
        rest = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.column_stack([x, rest])

    def ask(self, q: np.ndarray) -> np.ndarray:
        """Queries, scaled to the largest norm."""
        return np.column_stack([q * (self.norm / np.sqrt((q * q).sum(1)))[:, None], np.zeros(len(q))])

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every replica of some vectors."""
        d = _distances(self.even(x), self.centroids)
        near = np.argsort(d, 1, kind="stable")[:, :REPLICAS]
        own = np.take_along_axis(d, near, 1)
        keep = own <= BOUNDARY * own[:, :1] + 1e-12
        row, col = np.nonzero(keep)
        return row, near[row, col]

    def walk(self, q: np.ndarray, ratio: float, measured: list | None = None) -> list[int]:
        """Lists within ``ratio`` of the nearest centroid, by best-first search over the graph.

        The walk goes on while the nearest centroid not yet left lies within the ratio, or a
        little beyond it, so that a region that the graph enters from outside is found too.
        ``measured`` collects how many centroids were looked at.
        """
        dist = lambda ids: np.sqrt(np.maximum(((self.centroids[ids] - q) ** 2).sum(1), 0))
        seen = {0: float(dist([0])[0])}
        heap, best = [(seen[0], 0)], seen[0]
        while heap:
            d, i = heapq.heappop(heap)
            if d > ratio * 1.05 * best:
                break
            new = [j for j in self.graph[i].tolist() if j not in seen]
            for j, e in zip(new, dist(new).tolist() if new else ()):
                seen[j] = e
                best = min(best, e)
                heapq.heappush(heap, (e, j))
        if measured is not None:
            measured.append(len(seen))
        return [i for i, d in seen.items() if d <= ratio * best + 1e-12]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means in which a cluster's fill adds to the distance of its centroid."""
    rng = np.random.default_rng(3)
    c = x[np.sort(rng.choice(len(x), k, replace=False))]
    price = np.zeros(k)
    for _ in range(rounds):
        d = _distances(x, c) ** 2
        own = np.argmin(d + price, 1)
        size = np.bincount(own, minlength=k)
        price += 0.1 * d.min(1).mean() * (size * k / len(x) - 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def neighbour_graph(c: np.ndarray) -> np.ndarray:
    """Each centroid's nearest others, and a ring and a few far links that keep the graph connected."""
    k = len(c)
    d = _distances(c, c)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1, kind="stable")[:, : min(LINKS, max(k - 1, 1))]
    rng = np.random.default_rng(5)
    return np.column_stack([near % k, (np.arange(k) + 1) % k, rng.integers(0, k, (k, 4))])


def fit(sample: np.ndarray, norm: float, lists: int, k: int, target: float = TARGET) -> Index:
    """An index over ``lists`` lists whose ratio reaches the target recall of k neighbours within the sample."""
    index = Index(np.zeros((1, 1)), np.zeros((1, 1), int), norm, 1.0)
    x = np.unique(index.even(sample), axis=0)
    index.centroids = balanced_centroids(x, min(lists, len(x)))
    index.graph = neighbour_graph(index.centroids)
    probes = np.linspace(0, len(sample) - 1, min(len(sample), 300)).astype(int)
    product = sample[probes] @ sample.T
    product[np.arange(len(probes)), probes] = -np.inf
    found = np.argsort(-product, 1, kind="stable")[:, : min(k, len(sample) - 1)]
    row, at = index.lists_of(sample)
    member = np.zeros((len(sample), len(index.centroids)), bool)
    member[row, at] = True
    asked = index.ask(sample[probes])
    for ratio in np.arange(1.0, 2.01, 0.02):
        index.ratio = float(ratio)
        hits = [member[f][:, index.walk(q, ratio)].any(1).mean() for q, f in zip(asked, found) if len(f)]
        if not hits or np.mean(hits) >= target:
            break
    else:
        index.ratio = float("inf")
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _arrow(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _spread(index, name: str, route: bool):
    """Rows of vectors to their lists or, to ``route``, of queries to those they search."""

    def spread(batches):
        for whole in batches:
            for low in range(0, len(whole), 512):
                b = whole.slice(low, 512)
                x, ids = _matrix(b.column("v")), b.column(name).to_numpy()
                if route:
                    lists = [index.value.walk(q, index.value.ratio) for q in index.value.ask(x)]
                    row, at = np.repeat(np.arange(len(x)), [len(i) for i in lists]), np.array([i for own in lists for i in own], np.int64)
                else:
                    row, at = index.value.lists_of(x)
                yield pa.RecordBatch.from_pydict({"list": at.astype(np.int32), name: ids[row], "v": _arrow(x[row])})

    return spread


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best rows of each query, an id once, best first, ties to the smaller id."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    once = np.ones(len(ids), bool)
    once[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[once], ids[once], score[once]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], score[keep]


def _packed(query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.Table:
    """One row for each query (rows come sorted by it), ids and scores as bytes."""
    cuts = np.flatnonzero(np.diff(query)) + 1
    pack = lambda x: pa.array([p.tobytes() for p in np.split(x, cuts)] if len(x) else [], pa.binary())
    return pa.table({"query_id": query[np.concatenate(([0], cuts))] if len(query) else query, "ids": pack(ids), "scores": pack(score)})


def _unpacked(t: pa.Table):
    ids = [np.frombuffer(x, np.int64) for x in t.column("ids").to_pylist()]
    query = np.repeat(t.column("query_id").to_numpy(), [len(x) for x in ids])
    return query, np.concatenate(ids), np.concatenate([np.frombuffer(x, np.float64) for x in t.column("scores").to_pylist()])


def _merge(k: int, last: bool):
    def merge(key, t):
        query, ids, score = _best(*_unpacked(t), k)
        if not last:
            return _packed(query, ids, score)
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        return pa.table({"query_id": query, "rank": rank.astype(np.int32), "vec_id": ids, "score": score})

    return merge


def _score(k: int):
    def score(key, vectors, queries):
        rows = []
        if len(vectors) and len(queries):
            v, q = _matrix(vectors.column("v")), _matrix(queries.column("v"))
            vid, qid = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
            turn = np.argsort(vid, kind="stable")
            v, vid = v[turn], vid[turn]
            heads = np.flatnonzero(np.diff(vid, prepend=vid[0] - 1))
            hair = 1e-9 * np.sqrt((v * v).sum(1).max() * (q * q).sum(1).max())
            step = max(1, (1 << 21) // len(v))
            for low in range(0, len(q), step):
                s = q[low : low + step] @ v.T
                s[qid[low : low + step, None] == vid[None, :]] = -np.inf
                # The k-th best of distinct ids: the rows of one id are one answer.
                top = s if len(heads) == len(v) else np.maximum.reduceat(s, heads, axis=1)
                floor = np.partition(top, -k, 1)[:, -k] - hair if len(heads) > k else np.full(len(s), -np.inf)
                row, col = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
                exact = np.empty(len(row))
                for a in range(0, len(row), PAIRS):
                    exact[a : a + PAIRS] = (q[low + row[a : a + PAIRS]] * v[col[a : a + PAIRS]]).sum(1)
                rows.append((qid[low + row], vid[col], exact))
        return _packed(*_best(*(np.concatenate(x) for x in zip(*rows)), k)) if rows else _packed(*(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0))

    return score


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    sample: int = SAMPLE,
    lists: int | None = None,
    chunk: int = CHUNK,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first, ties to the smaller id."""
    spark = vectors.sparkSession
    whole = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    own = whole(vectors)
    shape = (
        own.groupBy(F.size("v").alias("d"))
        .agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"))
        .orderBy(F.desc("n"), F.desc("d"))
        .first()
    )
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = shape["d"], shape["n"]
    own = own.where(F.size("v") == d).distinct()
    asks = whole(queries).where(F.size("v") == d).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    picked = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    index = fit(np.array([r["v"] for r in picked]), float(np.sqrt(shape["top"])), lists or int(np.clip(round(n**0.5 / 8), 1, MAX_LISTS)), k)
    shared = spark.sparkContext.broadcast(index)
    post = cut(own.mapInArrow(_spread(shared, "vec_id", False), "list int, vec_id long, v array<double>"))
    route = cut(asks.mapInArrow(_spread(shared, "query_id", True), "list int, query_id long, v array<double>"))
    size = lambda df: {r["list"]: r["n"] for r in df.groupBy("list").agg(F.count("*").alias("n")).collect()}
    held, asked = size(post), size(route)
    grid = spark.createDataFrame(
        [(i, -(-held.get(i, 0) // chunk) or 1, -(-asked.get(i, 0) // chunk) or 1) for i in range(len(index.centroids))],
        "list int, nv int, nq int",
    )
    grid = F.broadcast(grid)  # a row for each list, at most MAX_LISTS
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    post = (
        post.join(grid, "list")
        .withColumn("vc", F.pmod(F.xxhash64("vec_id", "v"), F.col("nv")).cast("int"))
        .withColumn("qc", every("nq"))
        .select("list", "vc", "qc", "vec_id", "v")
    )
    route = (
        route.join(grid, "list")
        .withColumn("qc", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int"))
        .withColumn("vc", every("nv"))
        .select("list", "vc", "qc", "query_id", "v")
    )
    tile = ["list", "vc", "qc"]
    packed = "query_id long, ids binary, scores binary"
    found = post.groupBy(*tile).cogroup(route.groupBy(*tile)).applyInArrow(_score(k), packed)
    # Queries are merged in slots of some hundred rows, so that a group is neither tiny nor long.
    tiles = sum(-(-n // chunk) for n in held.values())
    if tiles > MERGED:
        parts = -(-tiles // MERGED)
        found = (
            found.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
            .groupBy("query_id", "part")
            .applyInArrow(_merge(k, False), packed)
        )
    slots = max(1, sum(asked.values()) // SLOT)
    found = found.withColumn("slot", F.pmod(F.xxhash64("query_id"), F.lit(slots)))
    return found.groupBy("slot").applyInArrow(_merge(k, True), "query_id long, rank int, vec_id long, score double")
