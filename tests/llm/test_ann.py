import numpy as np
import pytest

from tessera.llm import ann, queries
from tests.conftest import SF


def brute(rows, query_ids, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in query_ids:
        own = min((v.tolist() for i, v in good if i == q), default=None)
        if own is not None:
            best = {}
            for i, v in good:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float((np.array(own) * v).sum()))
            out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("chunk", [4096, 40])
def test_against_brute_force(spark, chunk):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(size=6) * rng.uniform(0.2, 3)).tolist()) for i in range(600)]
    rows += [(int(i), [2.0, 4.0, 0.0, 0.0, 0.0, 2.0]) for i in range(600, 900)]  # a third are copies of one vector
    rows += [(900, None), (905, []), (910, [0.0] * 6), (915, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (920, [float("nan")] + [1.0] * 5), (925, [float("inf")] + [1.0] * 5), (930, [1.0, 2.0]), (None, [1.0] * 6), (5, rows[5][1]), (5, rows[6][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = {}
    for r in ann.search(df, df.where("vec_id % 5 = 0"), k=7, lists=9, chunk=chunk).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows, [i for i in range(0, 1000, 5)], 7)
    assert got.keys() == want.keys()
    hits = total = 0
    for q, best in want.items():
        found = [got[q][k] for k in sorted(got[q])]
        assert sorted(got[q]) == list(range(1, len(found) + 1))
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        scores = dict(brute(rows, [q], 10**6)[q])
        assert all(abs(scores[i] - s) < 1e-12 for i, s in found)
        hits, total = hits + len({i for i, _ in found} & {i for i, _ in best}), total + len(best)
    assert hits / total >= 0.9
    tied = 0
    for q in want:  # copies have one score, so the least ids of them are found
        copies = [i for _, (i, _) in sorted(got[q].items()) if 600 <= i < 900]
        assert copies == [i for i in range(600, 900) if i != q][: len(copies)]
        tied += len(copies) > 1
    assert tied


@pytest.mark.parametrize("chunk", [4096, 40])
def test_an_id_stored_more_than_k_times_hides_no_others(spark, chunk):
    rng = np.random.default_rng(2)
    near = np.array([1.0, 2.0, 0.0, 0.0, 1.0, 0.0])
    rows = [(0, near.tolist())] + [(i, (rng.normal(size=6) * 0.3).tolist()) for i in range(1, 75)]
    rows += [(99, (near + rng.normal(size=6) * 0.01).tolist()) for _ in range(25)] + [(98, near.tolist())] * 60
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r.vec_id, r.score) for r in sorted(ann.search(df, df.where("vec_id = 0"), k=20, lists=1, chunk=chunk).collect(), key=lambda r: r.rank)]
    want = brute(rows, [0], 20)[0]
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 1e-12 for (_, a), (_, b) in zip(got, want))


def test_recall_on_the_driver_table(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in queries.op1_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        hits.append(len(got[int(ids[i])] & {int(ids[j]) for j in np.argsort(-s)[:20]}) / 20)
    assert np.mean(hits) >= 0.9


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.search(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 0.0)]
    assert ann.search(two.where("false"), two).count() == 0
    assert ann.search(two, two.where("false")).count() == 0
    assert SF


def test_the_graph_prunes_many_lists(spark):
    """With 500 lists the walk looks at a part of the centroids, queries search fewer still, and recall holds."""
    rng = np.random.default_rng(7)
    hubs = rng.normal(size=(60, 6)) * 4
    rows = [(int(i), (hubs[i % 60] + rng.normal(size=6) * 0.4).tolist()) for i in range(6000)]
    x = np.array([v for _, v in rows])
    index = ann.fit(x[:3000], float(np.sqrt((x * x).sum(1).max())), 500, 20)
    looked, searched = [], []
    for q in index.ask(x[::20]):
        searched.append(len(index.walk(q, index.ratio, looked)))
    assert len(index.centroids) == 500 and np.mean(looked) < 350 and np.mean(searched) < 200
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), k=20, lists=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(6000), -score))[:20].tolist()))
    print("recall", hits / 6000, "looked at", np.mean(looked), "searched", np.mean(searched))
    assert hits / 6000 >= 0.9
