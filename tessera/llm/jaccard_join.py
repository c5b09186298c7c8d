"""N-gram Jaccard join: MinHash prefixes in many trees, then exact verification.

Texts are sets of five-word shingles.  Texts with one and the same set form a copy
class, and only one text of a class goes on.  Every class has a MinHash signature
for each of TREES prefix tries, DEPTH values long.

In a tree a class meets all classes that share its matched prefix.  Matched prefixes
start at DEPTH values and are shortened, in all trees together, until the chance that
a partner at the threshold is missed in all of them, (1 - threshold ** depth) ** TREES,
is at most 1 - TARGET (five values at 0.8).  They are not shortened tree by tree after
what a class has met so far: that keeps long prefixes in just those trees where a missing
partner would turn up (README has the figures).

Every pair that meets is verified on the exact shingle sets, in the first tree where
it meets (its owner), so links are exact for whatever the forest brought together.

Plan.  The first pass turns texts into slim rows (set hash, signature).  A level of the
tries is a grouping by hashed prefix, its groups are the buckets; a class that is alone
everywhere drops out.  A bucket all of whose pairs have an earlier owner is dropped,
which leaves a family of near copies one or two buckets instead of TREES.  Texts move
once for every bucket left.  A bucket of more than BLOCK classes is verified as a grid of
blocks: no task holds more than two blocks, and a task returns counts and one root for
each class, never pairs.  Classes are then joined along verified links alone, so that
chance meetings don't grow into one component.  Work inside a group of m different near
copies is m squared comparisons of sets (matrix products), and each text goes to
m / BLOCK tiles; memory and output are linear in m.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words has
one shingle, all its words; null, empty and blank texts are never linked or
grouped; repeated rows are copies; null ids are allowed and a group's id is its
least id that isn't null; incoming columns are not looked at beyond id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components

from .common import cut, free_name, mix, row_slices, text_bytes, window_hashes, word_bounds, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH, TARGET = 20, 8, 0.999
#: Classes, and shingles, of a bucket that one block holds at most (one class at least).
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Rows that a broadcast may have; larger sides are shuffled.
BROADCAST_ROWS = 200_000
_U = np.uint64


def matched_depth(threshold: float, trees: int = TREES, target: float = TARGET) -> int:
    """Prefixes shortened until a pair at the threshold meets in some tree with the target probability; 1 if none does."""
    depth = DEPTH
    while depth > 1 and (1 - threshold**depth) ** trees > 1 - target:
        depth -= 1
    return depth


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    start, end, first = word_bounds(data, offsets)
    words = word_hashes(data, start, end)
    windows = window_hashes(words, size)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= size:
            out.append(np.unique(windows[a : z - size + 1]))
        elif z > a:
            out.append(mix(np.full(1, (words[a:z] * (np.arange(1, z - a + 1, dtype=_U) * _U(2) + _U(1))).sum() + _U(z - a))))
        else:
            out.append(np.zeros(0, _U))
    return out


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """MinHash signatures (rows without shingles get zeros)."""
    rng = np.random.default_rng(77)
    flip, odd = rng.integers(0, 2**63, k).astype(_U), rng.integers(0, 2**63, k).astype(_U) * _U(2) + _U(1)
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), k), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        for j in range(k):
            x = flat ^ flip[j]
            x *= odd[j]
            out[full, j] = np.minimum.reduceat(x, starts) >> _U(32)
    return out


def _slim(size: int, k: int):
    def slim(batches):
        for b in batches:
            column = b.column("text")
            for i, j in row_slices(column):
                sets = shingle_sets(column.slice(i, j - i), size)
                sign = signatures(sets, k)
                total = lambda salt: np.array([int(mix(s ^ _U(salt)).sum(dtype=_U)) for s in sets], _U).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b.column("doc_id").slice(i, j - i),
                    "th": b.column("th").slice(i, j - i),
                    "cid": mix(total(0x1234567).view(_U)).view(np.int64),
                    "c2": total(0x7654321),
                    "n": np.array([len(s) for s in sets], np.int64),
                    "sign": pa.array([r.tobytes() for r in sign], pa.binary()),
                })

    return slim


def _linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the Jaccard threshold."""
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), bool)
    both = np.zeros((len(a), len(b)), np.float32)
    values, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    rows_a, rows_b = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    col_a, col_b = column[: na.sum()], column[na.sum() :]
    shared = np.zeros(len(values), bool)
    shared[np.intersect1d(col_a, col_b)] = True
    place = np.cumsum(shared) - 1
    keep_a, keep_b = shared[col_a], shared[col_b]
    rows_a, col_a, rows_b, col_b = rows_a[keep_a], place[col_a[keep_a]], rows_b[keep_b], place[col_b[keep_b]]
    order_a, order_b = np.argsort(col_a, kind="stable"), np.argsort(col_b, kind="stable")
    rows_a, col_a, rows_b, col_b = rows_a[order_a], col_a[order_a], rows_b[order_b], col_b[order_b]
    for low in range(0, int(shared.sum()), 4096):
        pa_, pb_ = np.searchsorted(col_a, [low, low + 4096]), np.searchsorted(col_b, [low, low + 4096])
        x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        x[rows_a[pa_[0] : pa_[1]], col_a[pa_[0] : pa_[1]] - low] = 1
        y[rows_b[pb_[0] : pb_[1]], col_b[pb_[0] : pb_[1]] - low] = 1
        both += x @ y.T
    union = na[:, None] + nb[None, :] - both
    return both.astype(np.float64) >= threshold * union - 1e-9


def _roots(links: np.ndarray) -> np.ndarray:
    """For each node of a symmetric link matrix, the least node of its component."""
    root = np.arange(len(links))
    while True:
        low = np.minimum(root, np.where(links, root[None, :], len(links)).min(1, initial=len(links)))
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _unowned(meets_a: np.ndarray, meets_b: np.ndarray, tree: int) -> np.ndarray:
    """Which pairs share no bucket of an earlier tree."""
    free = np.ones((len(meets_a), len(meets_b)), bool)
    for t in range(tree):
        a, b = meets_a[:, t], meets_b[:, t]
        free &= (a[:, None] != b[None, :]) | (a == 0)[:, None]
    return free


def _compare(a: list[np.ndarray], b: list[np.ndarray], free: np.ndarray, threshold: float) -> np.ndarray:
    """Which free pairs are linked; where few are free, only these are compared."""
    if 20 * free.sum() > free.size:
        return _linked(a, b, threshold) & free
    out = np.zeros(free.shape, bool)
    for i, j in np.argwhere(free).tolist():
        both = len(np.intersect1d(a[i], b[j], assume_unique=True))
        out[i, j] = both >= threshold * (len(a[i]) + len(b[j]) - both) - 1e-9
    return out


def _verify(size: int, threshold: float):
    def verify(key, t):
        t = t.combine_chunks() if len(t) else t
        bucket, i, j, tree = (t.column(c).to_numpy() for c in ("bucket", "bi", "bj", "tree"))
        cid, block = t.column("cid").to_numpy(), t.column("block").to_numpy()
        meets = np.array(t.column("meets").to_pylist(), np.int64).reshape(len(t), -1)
        text = t.column("text").combine_chunks() if isinstance(t.column("text"), pa.ChunkedArray) else t.column("text")
        order = np.lexsort((cid, j, i, bucket))
        edges = np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        out = {"cid": [], "links": [], "root": []}
        for own in np.split(order, edges):
            own = own[np.concatenate(([True], np.diff(cid[own]) != 0))]
            inner = i[own[0]] == j[own[0]]
            left = block[own] == i[own[0]]
            a, b = np.flatnonzero(left), np.flatnonzero(left if inner else ~left)
            free = _unowned(meets[own[a]], meets[own[b]], int(tree[own[0]]))
            if inner:
                np.fill_diagonal(free, False)
            links = np.zeros((len(own), len(own)), bool)
            if free.any():
                sets = [shingle_sets(text.slice(k, 1), size)[0] for k in own.tolist()]
                links[np.ix_(a, b)] = _compare([sets[x] for x in a], [sets[x] for x in b], free, threshold)
                links |= links.T
            ids = cid[own]
            out["cid"].append(ids)
            out["links"].append(links.sum(1))
            out["root"].append(ids[_roots(links)])
        return pa.table({k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()})

    return verify


def forest(classes: DataFrame, depth: int, trees: int) -> DataFrame:
    """(cid, tree, bucket, meets): the buckets where a class meets others; ``meets`` has its bucket in each tree, 0 for none."""
    width = depth * 4
    prefixes = F.array(
        *[F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("sign", t * width + 1, width)).alias("bucket")) for t in range(trees)]
    )
    nodes = classes.select("cid", F.explode(prefixes).alias("n")).select("cid", "n.*")
    crowded = nodes.groupBy("bucket").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("bucket")
    held = nodes.join(crowded, "bucket").groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("tree", "bucket"))).alias("m"))
    meets = F.array(*[F.coalesce(F.try_element_at("m", F.lit(t)), F.lit(0).cast("long")) for t in range(trees)])
    rows = held.select("cid", "m", meets.alias("meets")).select("cid", "meets", F.explode("m").alias("tree", "bucket"))
    ends = (
        rows.groupBy("tree", "bucket")
        .agg(*[f(F.col("meets")[t]).alias(f"{n}{t}") for t in range(trees) for f, n in ((F.min, "a"), (F.max, "b"))])
    )
    shared = [F.when((F.col(f"a{t}") == F.col(f"b{t}")) & (F.col(f"a{t}") != 0), t) for t in range(trees)]
    return rows.join(ends.where(F.least(F.lit(trees), *shared) == F.col("tree")).select("tree", "bucket"), ["tree", "bucket"])


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few enough."""
    return F.broadcast(df) if rows <= most else df


def jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    size: int = SHINGLE,
    trees: int = TREES,
    block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, class_id, copy_id, n_links, is_kept, is_repeat, th.

    copy_id is the least doc_id with the same shingle set, class_id the least doc_id
    of everything linked to it directly or through others, n_links the number of
    other shingle sets within the threshold.  th is the hash of the text, kept where
    the row is the one of its class (least id, then hash, then a row number taken
    once) that a deduplication keeps, repeat where another row of the same doc_id and
    th is kept.
    """
    depth = matched_depth(threshold, trees)
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    rows = cut(
        source.mapInArrow(_slim(size, trees * depth), "doc_id long, th long, cid long, c2 long, n long, sign binary")
        .withColumn("row", F.monotonically_increasing_id())
    )
    full = rows.where("n > 0")
    classes = cut(
        full.groupBy("cid", "c2")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th", "row")).alias("rep"),
            F.min("n").alias("n"),
            F.min("sign").alias("sign"),
        )
        .select(
            "cid",
            "c2",
            F.col("rep.doc_id").alias("doc_id"),
            F.col("rep.th").alias("th"),
            F.col("rep.row").alias("row"),
            "n",
            "sign",
        )
    )
    met = forest(classes, depth, trees)
    sized = cut(met.join(classes.select("cid", "doc_id", "th", "n"), "cid"))
    blocks = (
        sized.groupBy("bucket")
        .agg(
            F.greatest(F.lit(1), F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles))
            .cast("int")
            .alias("nb")
        )
    )
    stat = sized.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    slots = max(1, 16 * stat["n"] // block_shingles)
    wanted = sized.select("cid", "doc_id", "th").distinct()
    texts = (
        source.withColumn("id", F.col("doc_id"))
        .drop("doc_id")
        .join(
            small(wanted, stat["rows"], broadcast_rows),
            on=[F.col("id").eqNullSafe(F.col("doc_id")), source["th"] == wanted["th"]],
        )
        .select("cid", "text")
    )
    texts = texts.groupBy("cid").agg(F.min("text").alias("text"))
    placed = sized.join(small(blocks, stat["rows"], broadcast_rows), "bucket").select("cid", "tree", "bucket", "meets", "nb")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb"))).join(texts, "cid")
    tiles = (
        placed.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        .withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    )
    tiles = tiles.withColumn(
        "slot",
        F.when(F.col("nb") == 1, F.pmod(F.xxhash64("bucket"), F.lit(slots))).otherwise(F.xxhash64("bucket", "bi", "bj")),
    )
    tiles = tiles.select("slot", "cid", "tree", "bucket", "meets", "block", "bi", "bj", "text")
    checked = cut(tiles.groupBy("slot").applyInArrow(_verify(size, threshold), "cid long, links long, root long"))
    links = checked.groupBy("cid").agg(F.sum("links").alias("n_links"))
    roots = connected_components(checked.where("links > 0"), "cid", "root")
    known = (
        classes.join(links, "cid", "left")
        .join(roots, classes["cid"] == roots["node"], "left")
        .select(
            classes["cid"],
            "c2",
            "doc_id",
            "th",
            "row",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("root", classes["cid"]).alias("root"),
        )
    )
    best = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th", "row")).alias("best"))
    known = (
        known.join(best, "root")
        .select(
            "cid",
            "c2",
            F.col("doc_id").alias("copy_id"),
            "n_links",
            F.col("best.doc_id").alias("class_id"),
            F.col("best.th").alias("best_th"),
            F.col("best.row").alias("best_row"),
        )
    )
    kept = F.col("row") == F.col("best_row")
    repeat = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("best_th")) & ~kept
    joined = (
        full.select("doc_id", "th", "row", "cid", "c2")
        .join(known, ["cid", "c2"])
        .select("doc_id", "class_id", "copy_id", "n_links", kept.alias("is_kept"), repeat.alias("is_repeat"), "th")
    )
    alone = (
        rows.where("n = 0")
        .select(
            "doc_id",
            F.col("doc_id").alias("class_id"),
            F.col("doc_id").alias("copy_id"),
            F.lit(0).cast("long").alias("n_links"),
            F.lit(True).alias("is_kept"),
            F.lit(False).alias("is_repeat"),
            "th",
        )
    )
    return joined.unionByName(alone)


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of every class of near copies: the one of the least doc_id.

    Of rows with one doc_id and text the one with the least hash of all columns stays.
    """
    id_, th, again_, row_ = (free_name(docs, n) for n in ("_tessera_id", "_tessera_th", "_tessera_repeat", "_tessera_row"))
    found = jaccard_join(docs, **options).where("not is_kept").select(F.col("doc_id").alias(id_), F.col("th").alias(th), F.col("is_repeat").alias(again_))
    found = cut(found.distinct())
    stat = found.agg(F.count("*").alias("rows"), F.count_if(again_).alias("repeats")).first()
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    on = [F.col("doc_id").eqNullSafe(F.col(id_)), key == F.col(th)]
    rest = docs.join(small(found, stat["rows"]), on=on, how="left_anti")
    if not stat["repeats"]:
        return rest
    again = docs.join(small(found.where(F.col(again_)), stat["repeats"]), on=on, how="left_semi")
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    hashed = [c for c, f in zip(quoted, docs.schema.fields) if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    one = again.groupBy("doc_id", key.alias(th)).agg(F.min_by(F.struct(*quoted), F.xxhash64(*hashed)).alias(row_))
    return rest.unionByName(one.select(f"{row_}.*"))
