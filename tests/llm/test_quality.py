import zlib

import numpy as np

from tessera.llm.quality import STATISTICS, THRESHOLD, classify, fit, isotonic, statistics
from tests.conftest import SF


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == held_out(i) and r.predicted == int(r.score >= THRESHOLD) for i, r in rows.items())
    marks = [(r.quality, rows[r.doc_id]) for r in labels.collect() if held_out(r.doc_id)]
    assert np.mean([q == r.predicted for q, r in marks]) > 0.98
    good, bad = [r.score for q, r in marks if q], [r.score for q, r in marks if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_held_out_labels_have_no_influence(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    hidden = [r.doc_id for r in labels.collect() if held_out(r.doc_id)]
    assert hidden
    a, b = fit(docs, labels), fit(docs, labels.where(~labels.doc_id.isin(hidden)))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.value, b.value)


def test_odd_rows(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, " \n"), (4, "x" * 3_000_000), (5, "word " * 200_000), (5, "again"), *((i, "Good plain text of a kind. " * 9 if i % 2 else "BAD!! $$$ ###\n" * 9) for i in range(10, 90))]
    docs = spark.createDataFrame([(*r, 0.5, 7) for r in rows], "doc_id long, text string, score double, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(10, 90)] + [(None, 1, "z"), (11, None, "z"), (11, 1, "z"), (9999, 0, "z")], "doc_id long, quality int, text string")
    out = classify(docs, labels)
    assert out.columns == ["doc_id", "text", "held_out", "score", "predicted"]
    got = out.select("doc_id", "score", "predicted").collect()
    assert len(got) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == i % 2 for i in range(10, 90))
    assert classify(docs.where("false"), labels).count() == 0
    assert {r.score for r in classify(docs, labels.where("false")).select("score").collect()} == {0.5}


def test_parts():
    assert isotonic(np.array([1, 1, 2, 1.0]), np.array([0, 1, 1, 1.0])).tolist() == [0, 2 / 3, 2 / 3, 1]
    import pyarrow as pa

    texts = ["a b", "", "one. Two!\none.", None]
    whole = statistics(pa.array(texts))
    assert whole.shape == (4, STATISTICS) and np.isfinite(whole).all()
    assert np.allclose(whole, np.concatenate([statistics(pa.array([t], pa.string())) for t in texts]))


def test_against_brute_force(spark):
    """The same model fitted in one piece: features of all labelled rows at once, ridge by least squares, isotonic by search."""
    import pyarrow as pa

    from tessera.llm import quality as Q

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    texts = {r.doc_id: r.text for r in docs.collect()}
    y = {r.doc_id: float(r.quality) for r in labels.collect() if r.doc_id in texts and not held_out(r.doc_id)}
    ids = sorted(y)
    x = statistics(pa.array([texts[i] for i in ids]))
    mean, scale = x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-8))
    p = Q.fourier((x - mean) / scale)
    check = np.array([zlib.crc32(str(i).encode()) % 5 == 1 for i in ids])
    target, a = np.array([y[i] for i in ids]), p[~check]
    penalty = np.sqrt(Q.RIDGE * max(len(a), 1)) * np.eye(a.shape[1])
    weights = np.linalg.lstsq(np.vstack([a, penalty]), np.concatenate([target[~check], np.zeros(a.shape[1])]), rcond=None)[0]
    model = fit(docs, labels)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale) and np.allclose(model.weights, weights, atol=1e-5)
    # Isotonic values: the largest least mean over stretches that end here or later.
    raw, t = p[check] @ weights, target[check]
    at = np.clip(((raw + 0.5) / 2 * Q.BINS).astype(int), 0, Q.BINS - 1)
    bins = np.unique(at)
    n, s = np.array([(at == b).sum() for b in bins]), np.array([t[at == b].sum() for b in bins])
    best = [max(min(s[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    want = 0.98 * np.interp(model.at, -0.5 + (bins + 0.5) / Q.BINS * 2, best) + 0.02 * np.clip((model.at + 0.5) / 2, 0, 1)
    assert np.allclose(model.value, want, atol=1e-6)
