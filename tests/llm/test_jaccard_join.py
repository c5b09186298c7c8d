import random
from collections import Counter
from pathlib import Path

import pytest

from tessera.llm.jaccard_join import drop_near_copies, jaccard_join, matched_depth
from tessera.operators.graph import connected_components


def shingles(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    keys = [k for k in sets if k]
    links = {k: [m for m in keys if m is not k and len(k & m) >= 0.8 * len(k | m)] for k in keys}
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    out = Counter()
    seen = {}
    for k in keys:
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                for m in links[todo.pop()]:
                    if m not in group:
                        group.add(m)
                        todo.append(m)
            least = low([i for m in group for i in sets[m]])
            seen.update(dict.fromkeys(group, least))
    for k, ids in sets.items():
        for i in ids:
            out[(i, seen[k], low(ids), len(links[k])) if k else (i, i, i, 0)] += 1
    return out


def corpus():
    rnd = random.Random(3)
    text = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "one  two"), (None, "one two three"), (None, "one two three"), (None, "null id here and on to more words")]
    n = 10
    for size in (8, 30, 120, 400):
        for _ in range(6):
            base = text(size)
            for _ in range(rnd.choice([1, 2, 6])):
                copy = list(base)
                for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                    copy[rnd.randrange(len(copy))] = rnd.choice(["x", "y", f"w{rnd.randrange(400)}"])
                rows.append((n, " ".join(copy)))
                n += 1
    base = text(60)
    for k in range(90):
        rows.append((n, " ".join([*base, f"tail{k}" if k % 3 else "tail"])))
        n += 1
    rows += rows[20:25]
    rows.append((n, " ".join(text(30_000))))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 7, "block_shingles": 900, "broadcast_rows": 0}])
def test_against_brute_force(spark, options):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_links int, th string").repartition(3)
    got = Counter((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in jaccard_join(docs, **options).collect())
    assert got == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, extra int").repartition(3)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id for r in kept.collect() if shingles(r.text) and r.doc_id is not None}
    want = {c for (i, c, _, _) in brute(rows) if i is not None and shingles(dict(rows)[i])}
    assert got == want
    assert {0, 1, 2} <= {r.doc_id for r in kept.collect()}


def test_repeated_rows_and_null_ids_leave_one_row(spark):
    long = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(1, long, 1), (1, long, 1), (1, long, 2), (2, long, 3), (None, other, 4), (None, other, 4), (None, other + " x", 5), (7, "a b", 6), (8, None, 7), (8, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(4)
    flags = jaccard_join(docs).where("doc_id = 1").collect()
    assert sorted((r.is_kept, r.is_repeat) for r in flags) == [(False, True), (False, True), (True, False)]
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, (r.text or "")[:2]) for r in kept.collect())
    assert got == {(1, "w0"): 1, (None, "v0"): 1, (7, "a "): 1, (8, ""): 2}
    again = drop_near_copies(docs.repartition(3, "extra"))
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(docs).count() == 0
    assert drop_near_copies(docs).count() == 0


def test_prefixes_are_shortened_until_the_target():
    assert matched_depth(0.8) == 5 and 1 - (1 - 0.8**5) ** 20 >= 0.999 > 1 - (1 - 0.8**6) ** 20
    assert matched_depth(0.95) == 8 and matched_depth(0.01) == 1


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_recall_of_the_forest(spark, threshold):
    """Chains of texts that drift apart: nearly all pairs at or above the threshold are found."""
    rnd, rows = random.Random(5), []
    for _ in range(25):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            words[rnd.randrange(150)] = f"w{rnd.randrange(10**6)}"
    sets = [shingles(t) for _, t in rows]
    want = sum(sum(1 for j in range(len(rows)) if i != j and len(a & sets[j]) >= threshold * len(a | sets[j])) for i, a in enumerate(sets))
    got = sum(r.n_links for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect())
    print(f"recall at {threshold}: {got / want:.4f} of {want}")
    assert 0.998 * want <= got <= want


def checkpoints(spark):
    return len(list(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).glob("rdd-*")))


def test_few_checkpoints(spark):
    """Texts, classes, buckets, links and edges, then one for each round of the components; stars need no round."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = checkpoints(spark)
    assert len(jaccard_join(docs, block=7, block_shingles=900).collect()) == len(rows)
    assert 5 <= checkpoints(spark) - before <= 5 + 3
    stars = spark.createDataFrame([(k, k % 5) for k in range(60)] + [(k, k) for k in range(5)], "a long, b long")
    before = checkpoints(spark)
    assert {(r.node, r.root) for r in connected_components(stars, "a", "b").collect()} == {(k, k % 5) for k in range(60)}
    assert checkpoints(spark) - before == 1
