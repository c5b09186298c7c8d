"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each whole text becomes a few document statistics (shares of kinds of bytes, word,
line and sentence shapes, repetition).  Random Fourier features approximate a
Gaussian kernel over the standardised statistics; a ridge regression on them is
fitted from normal equations that every partition sums on its own and Spark adds
up; isotonic regression over fixed score bins turns raw scores into
probabilities.  Three quarters of the training rows fit the ridge weights, one
quarter the calibration.

Plan: labels, LABELLED at most, are broadcast to the scan, and only the statistics of
their documents are computed to learn from; no text is shuffled.  What reaches the driver has a fixed size: the
moments, the normal equations (D + 1 squared) and the histogram of BINS scores.
Scoring is one pass of an Arrow UDF over the text column.

Defined cases: null text counts as empty; empty texts get the score of their
statistics (all zero); labels that are null are left out; a document labelled
more than once takes part with the mean of its labels; without a training row
every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, row_slices, text_bytes, word_bounds, word_hashes

FEATURES = 192
GAMMA = 0.04
RIDGE = 1e-3
BINS = 1024
SEED = 11
#: Labelled documents that a model is learnt from, at most.
LABELLED = 200_000
THRESHOLD = 0.3
STATISTICS = 20

_KIND = np.zeros((256, 10), dtype=np.float32)
for _i, _set in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\v\f", b"\n", b".,;:?", b"!", b"'\"()-", b"|#*%&$@^~_=+<>/\\[]{}`", bytes(range(128, 256))]):
    _KIND[list(_set), _i] = 1


def statistics(column: pa.Array) -> np.ndarray:
    """A row of STATISTICS numbers for each text."""
    parts = [_statistics(column.slice(i, j - i)) for i, j in row_slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, STATISTICS))


def _statistics(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    rows, size = len(column), np.diff(offsets)
    counts = np.zeros((rows, 256))
    for i in range(rows):
        counts[i] = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
    n = np.maximum(size, 1)[:, None]
    kinds = counts @ _KIND.astype(np.float64) / n
    start, end, first = word_bounds(data, offsets)
    words, length = np.diff(first), end - start
    per = lambda x: np.add.reduceat(np.append(x, 0).astype(np.float64), np.minimum(first[:-1], len(x))) * (words > 0)
    w = np.maximum(words, 1)
    mean = per(length) / w
    spread = np.sqrt(np.maximum(per(length.astype(np.float64) ** 2) / w - mean**2, 0))
    upper = (data[start] >= 65) & (data[start] <= 90) if len(start) else np.zeros(0)
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    closing = np.isin(last, list(b".?"))
    odd = np.isin(last, list(b"!|#*%&$@"))
    hashes = word_hashes(data, start, end)
    distinct, lines = np.zeros(rows), np.zeros(rows)
    for i in range(rows):
        distinct[i] = len(np.unique(hashes[first[i] : first[i + 1]])) / max(words[i], 1) ** 0.9 if words[i] else 0
        own = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        lines[i] = 1 - len(set(own)) / len(own)
    present = counts[:, counts.any(0)] / n
    entropy = -(present * np.log2(np.maximum(present, 1e-12))).sum(1)
    return np.column_stack(
        [
            kinds,
            np.log1p(words),
            mean,
            spread,
            per(upper) / w,
            per(closing) / w,
            per(odd) / w,
            distinct,
            lines,
            entropy,
            np.log1p(size) - np.log1p(counts[:, 10]),
        ]
    )


@dataclass
class Model:
    """Everything that a score needs; its size doesn't depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (STATISTICS, FEATURES))
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -6, 6) @ w + b), np.ones(len(z))])


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing fit to bin means total / count, weighted by count (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for c, t in zip(count, total):
        blocks.append([c, t, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            c2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), t / c) for c, t, n in blocks]) if blocks else np.zeros(0)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def _sums(rows: DataFrame, f, width: int) -> np.ndarray:
    """The sum over all rows of what ``f`` makes of each batch; partitions sum first, then Spark by position."""

    def part(batches):
        total = np.zeros(width)
        for b in batches:
            total += f(_matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({"i": np.arange(width, dtype=np.int32), "v": total})

    out = np.zeros(width)
    for r in rows.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the statistics of each text."""

    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS, x.ravel())

    return docs.select(*keep, stats("text").alias("x"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, labelled: int = LABELLED) -> Model:
    """A model from the labelled documents whose crc32(doc_id) modulo ``folds`` isn't 0.

    At most ``labelled`` of them (those of least hash) are learnt from, so that their ids and
    labels fit a broadcast and no text but theirs is looked at.
    """
    marks = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg(F.avg(F.col(label).cast("double")).alias("y"))
    )
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    own = docs.where(F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != 0)).select("doc_id", "text")
    known = cut(features(own.join(F.broadcast(marks), "doc_id"), "doc_id", "y"))
    ridge, checks = known.where(crc_mod("doc_id", folds) != 1), known.where(crc_mod("doc_id", folds) == 1)
    k = STATISTICS
    moments = _sums(known, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]), 2 * k + 1)
    n = moments[0]
    if n == 0:
        return Model(np.zeros(k), np.ones(k), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    mean = moments[1 : k + 1] / n
    scale = np.sqrt(np.maximum(moments[k + 1 :] / n - mean**2, 1e-8))
    d = FEATURES + 1

    def normal(x, y):
        p = fourier((x - mean) / scale)
        return np.concatenate([(p.T @ p).ravel(), p.T @ y])

    both = _sums(ridge, normal, d * d + d)
    gram, right = both[: d * d].reshape(d, d), both[d * d :]
    weights = np.linalg.solve(gram + RIDGE * max(gram[-1, -1], 1) * np.eye(d), right)
    low, high = -0.5, 1.5

    def binned(x, y):
        at = np.clip(((fourier((x - mean) / scale) @ weights - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)])

    bins = _sums(checks, binned, 2 * BINS)
    full = np.flatnonzero(bins[:BINS] > 0)
    if not len(full):
        return Model(mean, scale, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    value = isotonic(bins[full], bins[BINS + full])
    centre = low + (full + 0.5) / BINS * (high - low)
    # A little of the raw score keeps the order of documents within a flat stretch.
    at = np.linspace(low, high, 2 * BINS + 1)
    value = 0.98 * np.interp(at, centre, value) + 0.02 * np.clip((at - low) / (high - low), 0, 1)
    return Model(mean, scale, weights, at, value)


def score_column(model: Model, text: str = "text") -> Column:
    """The calibrated score of a text column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(texts)), pa.float64())

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """``docs`` with held_out, score and predicted; the labels' held-out fold is not used."""
    model = fit(docs, labels, folds=folds)
    docs = docs.drop("held_out", "score", "predicted")
    return (
        docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", folds) == 0, F.lit(False)))
        .withColumn("score", score_column(model))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
